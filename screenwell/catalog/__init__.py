"""All registered queries."""
import importlib

for _m in ("scans", "columns", "joins", "summaries", "similar", "flows"):
    importlib.import_module(f"{__name__}.{_m}")
