"""tallyspark: ledgers of batch file processing on Spark DataFrames."""
