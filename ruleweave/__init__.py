"""Rules-catalogue analytics on Spark: documents in, verified catalogue out."""
