"""Column helpers and small building blocks shared by the operators."""
