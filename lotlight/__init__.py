"""Procurement analytics and text preparation on Apache Spark."""
