"""Where the driver's tables lie (imported by the test modules)."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
