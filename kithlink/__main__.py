from kithlink.plans.pipeline import main

main()
