"""tilesmith: tiled-image, feature-bag and cohort analytics on Spark DataFrames."""
