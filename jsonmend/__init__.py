"""jsonmend: repair of malformed JSON and structured model output at table scale, on Spark."""

__version__ = "0.1.0"
