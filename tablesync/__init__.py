"""Change-data-capture tables on Spark: ordered row changes in, versioned Parquet tables out."""
