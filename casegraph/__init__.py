"""casegraph: security telemetry normalisation, detection and causal correlation on Spark."""

__version__ = "0.1.0"
