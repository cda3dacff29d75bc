"""pagesieve: web-text extraction, evaluation and cleaning as Spark plans."""

__version__ = "0.1.0"
