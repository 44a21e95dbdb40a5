"""tidewright: DataFrame-first operators for assessing, cleansing, matching and reconciling master data."""
