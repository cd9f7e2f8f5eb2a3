"""Schemas of the tables that operators take and give. Missing values are NULL everywhere; NaN never enters a table."""

from __future__ import annotations

RASTER = "grid_id string, row int, col int, v double"
COMPLEX_RASTER = "grid_id string, row int, col int, re double, im double"
TILE = "grid_id string, ty int, tx int, h int, w int, data array<double>"
LATTICE = "i int, j int, azimuth double, range double, snr double, keep boolean, filled boolean"
LATTICE_META = "window array<int>, skip array<int>, winsize array<int>, search array<int>, az_spacing double, rg_spacing double"
STACK = "freq string, d1 string, d2 string, row int, col int, z_re double, z_im double, p1 double, p2 double, n double"
SCREEN = "i int, j int, screen double, valid boolean, sigma double"
SCREEN_PARAMS = "provenance map<string,double>"
MAP_GRID = "x0 double, y0 double, dx double, dy double, nx int, ny int, epsg int"
GEOLOC = "i int, j int, x double, y double"
POLYGON = "id int, ring array<struct<x: double, y: double>>"
STREAK_INDEX = "freq string, d1 string, d2 string, R_fft double, theta_fft double, D_RA double, coh_mean double, n_cells bigint"
#: Sentinels that mean missing in files: unwrapper output, offset rasters, geolocation rasters (both 0), images (exact 0).
UNWRAP_NODATA = -10000.0
OFFSET_NODATA = -1e5
