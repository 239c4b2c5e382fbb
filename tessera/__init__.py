"""Tessera: numerical, statistical and text analytics as Spark DataFrame operators and Column expressions."""
