"""Log analytics on Spark: lines to fields, profiles, feature vectors, clusters, insights and reports."""
