"""Small evidence tables for tests. Times are given in minutes before the anchor."""

from __future__ import annotations

import datetime as dt

from incidentlens import schemas

ANCHOR = dt.datetime(2026, 6, 1, 3, 0, 0)


def at(minutes: float) -> dt.datetime:
    return ANCHOR + dt.timedelta(minutes=minutes)


def frame(spark, schema: str, rows: list[dict]):
    names = list(schemas.fields(schema))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


STACK = (
    'java.lang.NullPointerException: Cannot invoke "Order.getId()" because order is null\n'
    "\tat com.example.order.OrderService.create(OrderService.java:88)\n"
    "\tat com.example.order.OrderController.create(OrderController.java:42)"
)


def request(project="order-service", environment="staging", hours=2, **more):
    row = dict(request_id="r1", project_id=project, environment=environment, question="why? password=abc",
               from_ts=at(-60 * hours), to_ts=ANCHOR, max_results=500)
    return {**row, **more}


def log(minutes, seq, project="order-service", environment="staging", **more):
    row = dict(project_id=project, environment=environment, occurred_at=at(minutes), level="ERROR",
               logger="com.example.order.OrderService", trace_id=f"trace-{seq}", message="Create order failed",
               stack_trace=STACK, attributes={"exceptionClass": "NullPointerException"}, arrival_seq=seq)
    return {**row, **more}


def change(minutes, seq=1, evidence_id="deploy-1", project="order-service", environment="staging", **more):
    row = dict(evidence_id=evidence_id, project_id=project, environment=environment, type="DEPLOYMENT",
               occurred_at=at(minutes), attributes={"version": "v1.4.2"}, change_seq=seq)
    return {**row, **more}


def metric(minutes, name, seq=1, evidence_id="metric-1", project="order-service", environment="staging", **more):
    row = dict(evidence_id=evidence_id, project_id=project, environment=environment, metric=name, description=name,
               baseline_value=1.0, current_value=9.0, unit="count", observed_at=at(minutes), metric_seq=seq)
    return {**row, **more}


def sql(minutes, avg=2100, seq=1, evidence_id="sql-1", project="order-service", environment="staging", **more):
    row = dict(evidence_id=evidence_id, project_id=project, environment=environment,
               sql_template="select * from orders where customer_id = ?", occurrences=320, avg_duration_ms=avg,
               max_duration_ms=avg + 750, first_seen=at(minutes), source="mock", sql_seq=seq)
    return {**row, **more}
