from .slides import event_time, in_window, is_expiring, is_new, slide_index, slide_start, windows_of
from .vectors import CHEBYSHEV, MANHATTAN, SLACK, Metric, Space, distance_band, euclidean

__all__ = [
    "CHEBYSHEV", "MANHATTAN", "SLACK", "Metric", "Space", "distance_band", "euclidean", "event_time", "in_window",
    "is_expiring", "is_new", "slide_index", "slide_start", "windows_of",
]
