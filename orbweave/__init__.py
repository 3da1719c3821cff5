"""Earth-observation analytics on PySpark: monthly scene plans, orders, mosaics, per-pixel classification and distance surfaces.

Names are loaded when first used, so that a worker that needs one operator doesn't load all.
"""

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "plan_monthly_composites": "planner",
    "write_plan": "planner",
    "submit_orders_for_plan": "orders",
    "MosaicJob": "mosaic",
    "MosaicWorkflow": "mosaic",
    "run_mosaic": "mosaic",
    "train_rf": "classify",
    "predict_rf": "classify",
    "smooth_probs": "classify",
    "distance_to_vector": "classify",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f".plans.{_WHERE[name]}", __name__), name)
