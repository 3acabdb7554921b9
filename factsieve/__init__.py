"""factsieve: evidence-backed condition tables over document corpora, on Spark DataFrames."""
