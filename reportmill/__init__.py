"""Analytics over security-scanner reports on Spark."""

__version__ = "0.2.0"
__description__ = "Scanner reports to tables, statistics and consolidated findings on Spark"
__all__ = ["ConsolidationError", "FormatterError", "__version__", "detect", "find_reports", "process", "release", "supported_kinds", "version_info", "write", "write_documents", "write_large_documents"]

#: Exports by the module that has them; loaded when first asked for, so that the version costs no import of Spark.
_EXPORTS = {"process": "api", "write": "api", "write_documents": "api", "write_large_documents": "api", "release": "api", "detect": "sources.detect", "find_reports": "sources.detect", "ConsolidationError": "plans.rules", "FormatterError": "operators.report"}


def __getattr__(name: str) -> object:
    if name not in _EXPORTS:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"reportmill.{_EXPORTS[name]}"), name)


def supported_kinds() -> dict[str, dict]:
    """Registered kinds of reports with their description, suffixes and features."""
    from reportmill import kinds  # noqa: F401
    from reportmill.sources import adapters

    return adapters.supported()


def version_info() -> dict[str, object]:
    return {"package": "reportmill", "version": __version__, "description": __description__, "supported_formats": list(supported_kinds())}
