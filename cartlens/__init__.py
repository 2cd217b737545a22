"""Checkout and conversion analytics as lazy Spark DataFrame operators."""
