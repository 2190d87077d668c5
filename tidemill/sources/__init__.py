"""Sources and sinks by type name."""

from tidemill.plans import rollup  # noqa: F401
from tidemill.sources import databases, files, memory, remote, web  # noqa: F401  (they register themselves)
from tidemill.sources.base import SINKS, SOURCES, read_source, write_sink

__all__ = ["SINKS", "SOURCES", "read_source", "write_sink"]
