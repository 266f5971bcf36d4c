"""Where the small test tables lie."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
