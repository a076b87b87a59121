"""textbarge: bulk file-to-text engine on Spark DataFrames."""
