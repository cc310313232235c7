"""Training-data operators: ten corpus operations and the queries that apply them to whole tables."""
