"""Contact extraction over stored page snapshots, written as Spark jobs."""

from contactloom.options import ScanOptions

__all__ = ["ScanOptions"]
