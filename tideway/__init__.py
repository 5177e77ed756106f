"""Discrete-choice behaviour analytics as composable Spark DataFrame operators."""
