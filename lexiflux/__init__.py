"""lexiflux: lexicon-density text analytics and corpus preparation on Spark DataFrames."""
