"""Legal suffixes, address abbreviations and country aliases with their canonical forms."""

LEGAL_SUFFIXES = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
    "llc": "llc", "llp": "llp", "pvt": "pvt", "private": "pvt", "plc": "plc", "gmbh": "gmbh", "sarl": "sarl", "sa": "sa", "sas": "sas",
    "eurl": "eurl", "srl": "srl", "ag": "ag",
}

ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "apt": "apartment", "fl": "floor", "bldg": "building",
    "hwy": "highway", "ln": "lane", "dr": "drive", "sq": "square", "pl": "place", "no": "number", "nr": "near", "ste": "suite",
    "pkwy": "parkway", "ct": "court", "cir": "circle", "trl": "trail", "expy": "expressway", "rue": "rue", "bd": "boulevard", "av": "avenue",
}

COUNTRY_ALIASES = {
    "usa": "united states", "us": "united states", "u.s.": "united states", "u.s.a.": "united states", "america": "united states",
    "united states of america": "united states", "united states": "united states", "india": "india", "in": "india", "bharat": "india",
    "france": "france", "fr": "france", "république française": "france",
}
