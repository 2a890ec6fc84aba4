"""Writing results: datasets, hits, labels, reports and messages."""

from __future__ import annotations

import json
import smtplib
import urllib.request
from email.message import EmailMessage
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalars import origin_display
from corvid.operators.mlp import Mlp


def dataset(clips: DataFrame, path: str) -> None:
    """Save clips as Parquet, parted by category so that a category filter prunes folders."""
    clips.write.mode("overwrite").partitionBy("category").parquet(path)


def hits_csv_rows(hit: DataFrame) -> DataFrame:
    """detector, threshold, filename, category, score, origin, origin_name: a row a hit."""
    return hit.select("detector", "threshold", "filename", "category", "score", origin_display(F.col("origin")).alias("origin"), "origin_name")


def hits_csv(hit: DataFrame, path: str) -> None:
    hits_csv_rows(hit).write.mode("overwrite").csv(path, header=True)


def document(results: DataFrame, media_type: str) -> dict:
    """The nested results document of a frame of ``results_document`` shape: result-sized, built on the driver."""
    rows = results.orderBy("detector").collect()
    return {
        "media_type": media_type, "detectors_run": len(rows),
        "results": {r["detector"]: {"detector_name": r["detector"], "threshold": round(r["threshold"], 4), "total_hits": r["total_hits"], "hits": [h.asDict(True) for h in r["hits"]]} for r in rows},
    }


def results_json(results: DataFrame, path: str, media_type: str) -> str:
    """Write the results document as one JSON file through Spark's writers; returns a message with totals."""
    doc = document(results, media_type)
    spark = results.sparkSession
    spark.createDataFrame([(json.dumps(doc, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return f"{sum(r['total_hits'] for r in doc['results'].values())} hits of {doc['detectors_run']} detectors written to {path}"


def labels_json(labelset: DataFrame) -> DataFrame:
    """value: one JSON object a label, empty optional fields left out, good ones first."""
    return labelset.orderBy(F.desc("label"), "ord").select(F.to_json(F.struct(*[c for c in labelset.columns if c != "ord"])).alias("value"))


def detector_json(name: str, model: Mlp, threshold: float, media_type: str) -> str:
    return json.dumps({"name": name, "media_type": media_type, "threshold": round(threshold, 4), "weights": model.state()})


def display_lines(hit: DataFrame) -> DataFrame:
    """line: what a console shows of each hit, in rank order."""
    name = F.coalesce("origin_name", "filename")
    return hit.orderBy("detector", "rank").select(F.concat_ws("  ", F.lit(""), origin_display(F.col("origin")), name).alias("line"))


def clipboard(hit: DataFrame, column: str = "filename", separator: str = "\n") -> DataFrame:
    """text: one column of the hits in rank order, joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).cast("string").alias("v")))), lambda x: x["v"])
    return hit.groupBy("detector").agg(F.array_join(parts, separator).alias("text"))


def webhook(doc: dict, url: str, authorization: str | None = None, timeout: float = 30.0) -> int:
    """POST the results document as JSON; returns the status."""
    if not url.startswith(("http://", "https://")):
        raise ValueError("the url must be http or https")
    head = {"Content-Type": "application/json"} | ({"Authorization": authorization} if authorization else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(doc, default=str).encode(), head), timeout=timeout) as answer:
        return answer.status


def report_text(doc: dict) -> str:
    """The results document as plain text."""
    out = [f"Media type: {doc['media_type']}", f"Detectors run: {doc['detectors_run']}"]
    for r in doc["results"].values():
        out += ["", f"{r['detector_name']} (threshold {r['threshold']}): {r['total_hits']} hits"]
        out += [f"  {h['rank']}. clip {h['clip_id']}  {h['score']}" for h in r["hits"]] or ["  none"]
    return "\n".join(out)


def report_html(doc: dict) -> str:
    """The results document as a page of lists."""
    part = "".join(
        f"<h2>{escape(r['detector_name'])}</h2><p>{r['total_hits']} at or above {r['threshold']}</p><ol>" + "".join(f"<li>clip {h['clip_id']}: {h['score']}</li>" for h in r["hits"]) + "</ol>"
        for r in doc["results"].values()
    )
    return f"<html><body><h1>Results for {escape(str(doc['media_type']))}</h1>{part}</body></html>"


def email(doc: dict, host: str, port: int, sender: str, to: str, user: str | None = None, password: str | None = None) -> None:
    """Send the report over an encrypted connection."""
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = "Detection results", sender, to
    message.set_content(report_text(doc))
    message.add_alternative(report_html(doc), subtype="html")
    with smtplib.SMTP(host, port, timeout=30) as s:
        s.starttls()
        if user:
            s.login(user, password or "")
        s.send_message(message)


def eval_json(reports: dict[str, dict]) -> str:
    """The reports of ``operators.evaluate.run_eval`` as a JSON list."""
    return json.dumps(list(reports.values()), indent=2)
