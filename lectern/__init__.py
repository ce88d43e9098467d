"""lectern: retrieval-grounded question answering as Spark DataFrame jobs."""
from .functions.text import REFUSE

__all__ = ["REFUSE"]
__version__ = "0.1.0"
