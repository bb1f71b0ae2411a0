from georisk.jobs import main

main()
