"""Credit-risk features, encoding, modelling and scoring as Spark jobs."""
