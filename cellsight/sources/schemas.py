"""Explicit schemas of the stored tables and documents."""

from __future__ import annotations

# One DDL text per table; readers never infer types.
AREA_IDENTITY = (
    "area_id string, boundary_set_version string, source_feature_id int, source_key string, name_en string, district_en string, "
    "geometry_fingerprint string, source_key_occurrences int, review_required boolean"
)
RUN = (
    "run_id string, indicator string, obs_start timestamp, obs_end timestamp, status string, created_at timestamp, "
    "native_resolution string, notes string, candidate_only boolean"
)
RAINFALL_RUN = (
    "run_id string, source_product string, source_version string, analysis_year int, season_months array<smallint>, "
    "baseline_year_start int, baseline_year_end int, source_latest_month date, created_at timestamp, status string, notes string"
)
RAINFALL_CONDITION = (
    "run_id string, area_id string, rainfall_mm double, baseline_median_mm double, percentile double, condition_class string, "
    "grid_cell_count int, coverage_pct double, quality_status string"
)
RAINFALL_ARTIFACT = (
    "area_id string, name_en string, district_en string, rainfall_mm double, baseline_median_mm double, percentile double, "
    "condition_class string, grid_cell_count int, coverage_pct double, quality_status string"
)
PRELIMINARY_RAINFALL = (
    "run_id string, area_id string, rainfall_mm double, baseline_median_mm double, provisional_percentile double, "
    "comparison_status string, grid_cell_count int, coverage_pct double, quality_status string"
)
NDVI = (
    "run_id string, area_id string, ndvi_mean double, ndvi_median double, valid_pixel_count int, grid_cell_count int, "
    "coverage_pct double, qflag_nonzero_count int, quality_status string"
)
SWI = (
    "run_id string, area_id string, swi010_mean double, swi040_mean double, swi100_mean double, qflag040_mean double, "
    "valid_pixel_count int, grid_cell_count int, coverage_pct double, quality_status string"
)
LST = (
    "run_id string, area_id string, lst_c_mean double, errorbar_c_mean double, ppp_mean double, fobs_mean double, qflag_mean double, "
    "valid_pixel_count int, grid_cell_count int, coverage_pct double, quality_status string"
)
WAPOR = (
    "run_id string, area_id string, transpiration_mm double, aeti_mm double, valid_pixel_count int, grid_cell_count int, "
    "coverage_pct double, quality_status string"
)
COMPOSITE_PROFILE = (
    "run_id string, area_id string, profile string, ndmi_mean double, ndmi_median double, spatial_coverage_pct double, "
    "two_observation_coverage_pct double, median_valid_observation_count double, valid_spatial_pixel_count bigint, "
    "total_eligible_pixel_count bigint, valid_observation_pixel_count bigint, candidate_acquisition_count bigint, "
    "usable_acquisition_count bigint, first_acquisition_at timestamp, last_acquisition_at timestamp, median_acquisition_at timestamp, "
    "adjacency_accepted_pixel_count bigint, evidence_tier string"
)
SEASONAL_REFERENCE = (
    "reference_id string, area_id string, calendar_month int, valid_year_count bigint, median_value double, p20_value double, p80_value double"
)
OUTLOOK = (
    "run_id string, variable string, issued_at timestamp, valid_from date, valid_to date, lead_months smallint, status string, "
    "representation string, below_normal_probability decimal(5,4), near_normal_probability decimal(5,4), "
    "above_normal_probability decimal(5,4), coverage_pct decimal(5,2), quality_status string"
)
CELLS = "run_id string, band string, row int, col int, value double, is_masked boolean"
GRIDS = (
    "run_id string, product string, band string, x0 double, y0 double, dx double, dy double, width int, height int, crs int, "
    "nodata double, scale double, byte_size bigint"
)
RINGS = "array<array<struct<x:double,y:double>>>"
FEATURES = f"layer string, feature_id string, geom_type string, crs int, rings {RINGS}, attrs map<string,string>"
GAZETTEER = (
    "type string, id string, name string, name_norm string, aliases array<string>, parent struct<district_id:string>, "
    "center array<double>, bbox array<double>"
)
GEOJSON = (
    "type string, features array<struct<id:string, geometry:string, properties:string>>"
)
CATALOGUE_ITEM = "id:string, collection:string, properties:struct<datetime:string, end_datetime:string, start_datetime:string>"
