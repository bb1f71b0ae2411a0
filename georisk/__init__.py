"""georisk: geo-temporal incident risk on Spark (DataFrame / SQL / Spark ML)."""

from georisk.functions.grid import GridSpec
from georisk.session import build_session, shared_path, shared_root

__all__ = ["GridSpec", "build_session", "shared_path", "shared_root"]
