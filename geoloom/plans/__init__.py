"""Query plans over the driver's tables; importing this package registers all of them."""

from geoloom.catalog import ORACLE_SQL, QUERIES

from . import conversion_plans, geometry_plans, overlay_plans, pipeline_plans, raster_plans, source_plans, sql_plans, stencil_plans, vector_plans  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
