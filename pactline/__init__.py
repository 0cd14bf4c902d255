"""A Spark-first engine for analysing portfolios of agreements and other long documents."""
