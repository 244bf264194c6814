"""Analytics over large collections of Markdown notes, as Spark DataFrames."""
