"""Topic analytics on Spark: text preparation, topic models and their evaluation as DataFrame plans."""

__version__ = "0.1.0"
