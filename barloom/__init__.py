"""barloom: analytics over market bars and text collections, expressed as Spark jobs."""
