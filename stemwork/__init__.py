"""stemwork: detection scoring, matching, fusion and calibration on Spark DataFrames."""
