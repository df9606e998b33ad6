"""Tiny input frames with the logical source schemas (missing fields are NULL)."""

from usagelens.schemas import AUDIT_LOG, LIST_PRICES, QUERY_HISTORY, USAGE


def frame(spark, schema, records):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def history(spark, *records):
    defaults = {"workspace_id": 1, "compute": {"warehouse_id": "w1"}, "client_application": "Editor"}
    recs = []
    for r in records:
        r = {**defaults, **r}
        if isinstance(r["compute"], dict):
            r["compute"] = (r["compute"]["warehouse_id"],)
        recs.append(r)
    return frame(spark, QUERY_HISTORY, recs)


def usage(spark, *records):
    recs = []
    for r in records:
        r = dict(r)
        r["usage_metadata"] = (r.pop("warehouse_id", "w1"),)
        r.setdefault("sku_name", "PREMIUM_SERVERLESS_SQL_COMPUTE")
        recs.append(r)
    return frame(spark, USAGE, recs)


def prices(spark, *pairs):
    return frame(spark, LIST_PRICES, [{"sku_name": s, "pricing": (p,)} for s, p in pairs])


def audit(spark, *records):
    recs = []
    for r in records:
        r = dict(r)
        r["user_identity"] = (r.pop("email", None),)
        r["response"] = (r.pop("status_code", 200), r.pop("error_message", None), r.pop("result", None))
        r.setdefault("request_params", {})
        recs.append(r)
    return frame(spark, AUDIT_LOG, recs)
