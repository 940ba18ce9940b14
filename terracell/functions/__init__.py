"""Column functions: grids, time, geometry, packing, physical corrections, basis functions."""
