"""Places of the driver's test tables, in a module whose name no other test folder has."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
