"""echoloom: text-repetition analytics on Spark DataFrames."""
