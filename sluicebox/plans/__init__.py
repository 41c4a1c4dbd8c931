"""The relational model, its views and the jobs built from the operators."""
