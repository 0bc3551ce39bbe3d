"""plumbline: analytics over banks of image embeddings, expressed in Spark DataFrames."""
