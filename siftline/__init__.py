"""Analytics over stored web pages, contacts and text, on Spark DataFrames."""
