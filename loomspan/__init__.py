"""loomspan: text, interval and corpus analytics written as Spark DataFrame transforms."""

__version__ = "0.1.0"
