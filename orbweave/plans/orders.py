"""Orders for a monthly plan: batched requests, and replacements for scenes that can't be had.

A client is anything with create_order(request) that returns a mapping with `id` or raises; Outbox writes requests as JSON lines for whoever
delivers them. Replacements come from the same catalog table that plans are made from.
"""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import props as P
from ..operators import orders as O
from ..operators import scenes as SC
from ..session import discard, materialise, scratch_file
from ..sources import vector
from . import planner

log = logging.getLogger("orbweave.order")


class Client(Protocol):
    def create_order(self, request: dict) -> dict: ...


class Outbox:
    """Requests as lines of a file; ids count from 1."""

    def __init__(self, path: str) -> None:
        self.path, self.n = path, 0

    def create_order(self, request: dict) -> dict:
        self.n += 1
        with open(self.path, "a", encoding="utf-8") as out:
            out.write(json.dumps(request) + "\n")
        return {"id": f"outbox-{self.n}"}


def load_plan(path: str) -> dict:
    with open(path, encoding="utf-8") as text:
        plan = json.load(text)
    if not isinstance(plan, dict):
        raise ValueError("A plan is a JSON object keyed by month.")
    return plan


def clip(path: str) -> dict:
    """The area as GeoJSON in degrees, within the service's number of vertices."""
    area, crs = vector.load_area(path)
    return area.project(crs, "EPSG:4326").simplified(planner.MAX_VERTICES).to_json()


def bundle(sr_bands: int) -> str:
    if sr_bands not in O.BUNDLES:
        raise ValueError("sr_bands must be 4 or 8.")
    return O.BUNDLES[sr_bands]


def request(month: str, number: int, ids: list[str], prefix: str, product: str, tools: list[dict], archive_type: str | None, single_archive: bool) -> dict:
    """The request of a month's order of that number, counted from 1."""
    return O.document(f"{prefix}_{month}" + ("" if number == 1 else f"_{number}"), ids, product, archive_type, single_archive, tools)


def inaccessible(message: str) -> list[str]:
    """operators.orders.inaccessible of one message."""
    return _spark().range(1).select(O.inaccessible(F.lit(message)).alias("ids")).first()["ids"]


def _spark() -> SparkSession:
    return SparkSession.active()


def month_range(month: str, entry: dict) -> tuple[date, date]:
    """The range that the plan's filters keep, else the calendar month."""
    own = entry.get("filters") or {}
    first = date.fromisoformat(own["month_start"]) if own.get("month_start") else date.fromisoformat(f"{month}-01")
    last = date.fromisoformat(own["month_end"]) if own.get("month_end") else (first.replace(day=1) + timedelta(days=32)).replace(day=1) - timedelta(days=1)
    return first, last


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _share(value) -> float | None:
    v = _number(value)
    return None if v is None else max(0.0, min(1.0, v / 100 if v > 1 else v))


def replacement_table(catalog: DataFrame, entry: dict, month: str, area: dict, wanted: int, exclude: set[str] | DataFrame) -> DataFrame:
    """The best scenes of the month that the plan's own filters allow and that aren't excluded (a set, or a table with item_id): rank, item_id, collection_id, clear_fraction, combined, properties."""
    own = entry.get("filters") or {}
    weight = _number(own.get("quality_weight"))
    first, last = month_range(month, entry)
    collection = own.get("collection")
    found = planner.search(catalog, geo.Geometry.read(area), first, last, [collection] if collection else [own.get("item_type") or "PSScene"], own.get("sun_elevation_min"), own.get("cloud_max"), own.get("imagery_type"), own.get("instrument_types"), own.get("limit"))
    if "ord" not in found.columns:
        found = planner._numbered(found)
    out = exclude if isinstance(exclude, DataFrame) else found.sparkSession.createDataFrame([(x,) for x in sorted(exclude)], "item_id string")
    if "collection_id" not in found.columns:
        found = found.withColumn("collection_id", F.lit(None).cast("string"))
    best = SC.replacements(
        found,
        wanted,
        out,
        own.get("instrument_types"),
        own.get("min_clear_fraction") or 0.0,
        0.35 if weight is None else max(0.0, min(1.0, weight)),
        require_ground_control=bool(own.get("require_ground_control")),
        quality_category=SC.off(own.get("quality_category")),
        publishing_stage=SC.off(own.get("publishing_stage")),
        max_view_angle=_number(own.get("max_view_angle")),
        max_anomalous=_number(own.get("max_anomalous_pixels")),
        max_shadow=_share(own.get("max_shadow_fraction")),
        max_snow_ice=_share(own.get("max_snow_ice_fraction")),
        max_heavy_haze=_share(own.get("max_heavy_haze_fraction")),
        min_visible=_share(own.get("min_visible_confidence")),
        min_clear=_share(own.get("min_clear_confidence")),
    )
    return best.select("rank", "item_id", "collection_id", "clear_fraction", "combined", P.snapshot(F.col("props"), P.ORDER_SNAPSHOT).alias("properties"))


def find_replacements(catalog: DataFrame, entry: dict, month: str, area: dict, wanted: int, exclude: set[str] | DataFrame) -> list[dict]:
    """The rows of replacement_table as a plan has them."""
    if wanted <= 0:
        return []
    collection = (entry.get("filters") or {}).get("collection")
    rows = replacement_table(catalog, entry, month, area, wanted, exclude).orderBy("rank").collect()  # as many as were dropped
    return [{"id": r["item_id"], "collection": r["collection_id"] or collection or "PSScene", "clear_fraction": r["clear_fraction"], "properties": r["properties"].asDict()} for r in rows]


def submit_orders_for_plan(
    plan: dict | str,
    aoi_path: str,
    sr_bands: int = 4,
    harmonize_to: str | None = None,
    order_prefix: str = "plan",
    archive_type: str | None = "zip",
    single_archive: bool = True,
    *,
    client: Client,
    catalog: DataFrame | None = None,
    replace: Callable[..., list[dict]] | None = None,
) -> dict:
    """One order for each run of 500 scenes of a month: {month: {order_id, order_ids, item_ids}}.

    A refused order drops the scenes named in the error, takes as many replacements and tries again; any other error ends the month,
    whose result is then the ids that were to be ordered, without an order.
    """
    plan = load_plan(plan) if isinstance(plan, str) else plan
    area, ask = _asking(aoi_path, sr_bands, harmonize_to, order_prefix, archive_type, single_archive)
    if replace is None:
        replace = (lambda **k: find_replacements(catalog, k["entry"], k["month"], area, k["wanted"], k["exclude"])) if catalog is not None else (lambda **k: [])
    return {month: _submit_month(month, plan[month], client, replace, ask) for month in sorted(plan)}


def submit_orders_for_table(
    items: DataFrame,
    aoi_path: str,
    sr_bands: int = 4,
    harmonize_to: str | None = None,
    order_prefix: str = "plan",
    archive_type: str | None = "zip",
    single_archive: bool = True,
    *,
    by: str = "month",
    client: Client,
    entries: dict | None = None,
    catalog: DataFrame | None = None,
    replace: Callable[..., list[dict]] | None = None,
) -> DataFrame:
    """The same for a plan of any length, a table of by, ord and id: by, place (from 0), id, order_id, orders (how many the month has).

    The driver holds one order at a time. entries may have a month's filters; `exclude` is a table with item_id here, and a replacement
    must be none of its items.
    """
    spark = items.sparkSession
    area, ask = _asking(aoi_path, sr_bands, harmonize_to, order_prefix, archive_type, single_archive)
    if replace is None:
        replace = (lambda **k: find_replacements(catalog, k["entry"], k["month"], area, k["wanted"], k["exclude"])) if catalog is not None else (lambda **k: [])
    held = materialise(O.runs(O.batches(items.select(by, "ord", "id"), by), by), "order-runs")
    path, months = scratch_file(spark, "orders.jsonl"), []
    with open(path, "w", encoding="utf-8") as out:
        for month, own in itertools.groupby(held.orderBy(by, "batch").toLocalIterator(), lambda r: r[by]):
            known: set[str] = set()

            def exclude(month=month, known=known) -> DataFrame:
                mine = held.filter(F.col(by) == month).select(F.explode("ids").alias("item_id"))
                return mine.unionByName(spark.createDataFrame([(x,) for x in sorted(known)], "item_id string"))

            first, n, failed = 0, 0, False
            try:
                for order, ids in _orders(month, (entries or {}).get(month, {}), ({"id": i} for r in own for i in r["ids"]), client, replace, ask, known, exclude, False):
                    out.write(json.dumps({"by": month, "order_id": None if order is None else str(order), "failed": False, "first": first, "ids": ids}) + "\n")
                    first, n = first + len(ids), n + 1
            except _Ended as end:
                failed, n = True, 0
                out.write(json.dumps({"by": month, "order_id": None, "failed": True, "first": 0, "ids": end.ids}) + "\n")
            months.append((month, n, failed))
    discard(held)
    told = spark.read.schema("by string, order_id string, failed boolean, first long, ids array<string>").json(f"file://{path}")
    state = spark.createDataFrame(months, "by string, orders long, failed boolean")
    rows = told.join(F.broadcast(state), ["by", "failed"])  # a row a month
    return rows.select(F.col("by").alias(by), "first", "order_id", "orders", F.posexplode("ids").alias("k", "id")).select(by, (F.col("first") + F.col("k")).alias("place"), "id", "order_id", "orders")


def _asking(aoi_path: str, sr_bands: int, harmonize_to: str | None, prefix: str, archive_type: str | None, single_archive: bool) -> tuple[dict, Callable[[str, int, list[str]], dict]]:
    """The area, and what makes a request of a month, a number and ids."""
    area, product = clip(aoi_path), bundle(sr_bands)
    tools: list[dict] = [{"clip": {"aoi": area}}]
    if harmonize_to and harmonize_to.lower() == "sentinel2":
        tools.append({"harmonize": {"target_sensor": "Sentinel-2"}})
    return area, lambda month, number, ids: request(month, number, ids, prefix, product, tools, archive_type, single_archive)


class _Ended(Exception):
    """An error that names no scenes has ended a month, with these ids to be ordered."""

    def __init__(self, ids: list[str]) -> None:
        super().__init__()
        self.ids = ids


def _orders(month, entry, items: Iterable[dict], client, replace, ask, known: set[str], exclude: Callable, again: bool) -> Iterator[tuple]:
    """The id and the items of each order that a month's items are taken in. known gets what is refused and what replaces it. Items
    that come again are left out; unless `again`, only replacements can."""
    items, front, done, number = iter(items), [], set(), 1
    while True:
        batch: list[dict] = []
        while len(batch) < O.MAX_ITEMS and (i := front.pop() if front else next(items, None)):
            if i["id"] not in done:
                batch.append(i)
        if not batch:
            return
        while True:
            ids = [x for x in dict.fromkeys(i["id"] for i in batch) if x not in done]
            if not ids:
                break
            try:
                answer = client.create_order(ask(month, number, ids))
            except Exception as why:
                lost = inaccessible(str(why))
                if not lost:
                    log.error("The order for %s failed: %s", month, why)
                    raise _Ended(ids) from why
                log.warning("%s: %d scenes can't be had.", month, len(lost))
                done |= set(lost)
                known |= set(lost)
                new = replace(entry=entry, month=month, wanted=len(lost), exclude=exclude())
                known |= {i["id"] for i in new}
                batch = [i for i in batch if i["id"] not in done] + new
                front += batch[: O.MAX_ITEMS - 1 : -1]  # what is over comes first again
                batch = batch[: O.MAX_ITEMS]
                continue
            order = answer.get("id") if isinstance(answer, dict) else getattr(answer, "id", None)
            done |= set(ids) if again else known.intersection(ids)
            number += 1
            yield order, ids
            break


def _submit_month(month, entry, client, replace, ask) -> dict:
    items = [i for i in entry.get("items", []) if i.get("id")]
    if not items:
        return {"order_id": None, "item_ids": []}
    result: dict = {"order_id": None, "order_ids": [], "item_ids": []}
    known = {i["id"] for i in items}
    try:
        for order, ids in _orders(month, entry, items, client, replace, ask, known, lambda: set(known), True):
            result["order_ids"].append(order)
            result["order_id"] = result["order_id"] or order
            result["item_ids"] += ids
    except _Ended as end:
        return {"order_id": None, "order_ids": [], "item_ids": end.ids}
    return result


def summary(results: dict) -> str:
    """A line for each month."""
    if not results:
        return "No orders submitted."
    head = "Month     Items  Order ID"
    lines = [head, "-" * len(head)]
    lines += [f"{m:8}  {len(results[m].get('item_ids') or []):5d}  {results[m].get('order_id') or '-'}" for m in sorted(results)]
    return "\n".join(lines)
