"""Comment filtering and spam scoring on Spark."""

from .functions.scoring import PRESETS, analyze
from .plans.run import Options, Result, run, run_urls
from .plans.scoring import analyze_batch, analyze_comments, filter_spam
from .session import configure

__all__ = [
    "PRESETS", "Options", "Result", "analyze", "analyze_batch", "analyze_comments", "configure",
    "filter_spam", "run", "run_urls",
]
