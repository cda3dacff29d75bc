"""python -m pagesieve.cli build|infer|extract|evaluate|serve: the batch steps and the service over files."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagesieve.operators.extract import lower_case, page_texts, predicted_text, with_missing
from pagesieve.operators.predict import Scorer, infer, load_weights, numpy_scorer
from pagesieve.plans.pipelines import all_text, build, evaluation, html_pages
from pagesieve.sources.files import read_features, read_gold, read_predictions, read_textnodes, write_csv, write_features, write_tsv
from pagesieve.sources.warc import fetched, read_responses


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagesieve")
    sub = p.add_subparsers(dest="step", required=True)
    b = sub.add_parser("build", help="WARC archives to feature rows and text nodes")
    b.add_argument("--path", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--language", default="en")
    i = sub.add_parser("infer", help="feature rows to predictions, by a weights file")
    i.add_argument("--features", required=True)
    i.add_argument("--weights", required=True)
    i.add_argument("--out", required=True)
    e = sub.add_parser("extract", help="predictions and text nodes to page texts")
    v = sub.add_parser("evaluate", help="predictions against gold judgments")
    for s in (e, v):
        s.add_argument("--predictions", required=True)
        s.add_argument("--textnodes", required=True)
        s.add_argument("--out")
    v.add_argument("--gold", required=True)
    h = sub.add_parser("serve", help="POST /predict/ with a url answers its text")
    h.add_argument("--host", default="127.0.0.1")
    h.add_argument("--port", type=int, default=1688)
    h.add_argument("--weights", help="score the nodes of a page; without it every text node is taken for Primary")
    return p


def predict(spark: SparkSession, url: str, scorer: Scorer | None = None) -> tuple[int, dict]:
    """(HTTP status, answer) for one url: 400 where the page can't be had, a null text where it has none."""
    pages = fetched(spark.createDataFrame([(url,)], "url STRING")).where("status = 200")
    rows = html_pages(pages.select("url", "content"), None).select("url", "html").collect()
    if not rows:
        return 400, {"detail": "the page could not be fetched"}
    html = spark.createDataFrame(rows, "url STRING, html STRING")
    if scorer is None:
        got = all_text(html).first()
    else:
        chunks, texts = build(html)
        got = lower_case(page_texts(predicted_text(infer(chunks, scorer), texts, "Primary"))).first()
    return 200, {"Text": got["text"] if got else None}


def serve(spark: SparkSession, host: str, port: int, scorer: Scorer | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", "0"))))
                status, answer = predict(spark, body["url"], scorer) if self.path.rstrip("/") == "/predict" else (404, {"detail": "not found"})
            except (ValueError, KeyError, TypeError):
                status, answer = 422, {"detail": "a JSON object with url is needed"}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"pagesieve {a.step}").getOrCreate()
    if a.step == "build":
        chunks, texts = build(html_pages(read_responses(spark, a.path), a.language))
        write_features(chunks, f"{a.out}/encoded")
        write_csv(texts, f"{a.out}/textnodes")
    elif a.step == "infer":
        rows, _ = read_features(spark, a.features)
        write_tsv(infer(rows, numpy_scorer(load_weights(a.weights))), a.out)
    elif a.step == "extract":
        texts = page_texts(predicted_text(read_predictions(spark, a.predictions), read_textnodes(spark, a.textnodes)))
        write_csv(lower_case(texts), a.out or "text")
    elif a.step == "evaluate":
        predictions, textnodes = read_predictions(spark, a.predictions), read_textnodes(spark, a.textnodes)
        print(json.dumps(evaluation(predictions, textnodes, read_gold(spark, a.gold)).first().asDict()))
        if a.out:
            texts = page_texts(predicted_text(predictions, textnodes, "Primary"))
            write_csv(with_missing(texts, textnodes).orderBy(F.col("Url")), a.out)
    else:
        serve(spark, a.host, a.port, numpy_scorer(load_weights(a.weights)) if a.weights else None).serve_forever()


if __name__ == "__main__":
    main()
