"""Architecture analytics over source trees as Spark queries, and (in llm) operators that prepare training text."""
