"""quernworks: a Spark-first engine for curating, scoring and packing large datasets."""
