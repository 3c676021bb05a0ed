"""Command line entry points mirroring the reference's three scripts.

    python -m slantspark build   --articles A.xml --truth G.xml --out DIR [--mode lead|full] [--format parquet|csv]
                                 [--ids quarantine|failfast] [--xml-errors raise|quarantine]
    python -m slantspark train   --features DIR/features --models DIR/models [--format parquet|csv] [--fit-rows N]
    python -m slantspark predict --models DIR/models (--text "..." | --texts T.parquet --text-col text) [--out P]
    python -m slantspark textclf --merged DIR/merged --model DIR/textclf [--labels 3|5] [--format parquet|csv] [--strict] [--text "..."]

``build`` also writes ``profile`` and ``rejected_ids``, and with ``--xml-errors quarantine`` ``rejected_xml``.

Run under spark-submit on a cluster (the session comes from its configuration).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from slantspark.plans import dataset as DS
from slantspark.sources import delimited as D
from slantspark.sources import xml as X


def _texts(spark, args):
    if args.text is not None:
        return D.literal_text(spark, args.text, "article_text"), "article_text"
    return spark.read.parquet(args.texts), args.text_col


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="slantspark")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--articles", required=True)
    b.add_argument("--truth", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--mode", default="lead", choices=["lead", "full"])
    b.add_argument("--ids", default="quarantine", choices=["quarantine", "failfast"])
    b.add_argument("--xml-errors", default="raise", choices=["raise", "quarantine"])
    t = sub.add_parser("train")
    t.add_argument("--features", required=True)
    t.add_argument("--models", required=True)
    t.add_argument("--fit-rows", type=int)
    pr = sub.add_parser("predict")
    pr.add_argument("--models", required=True)
    pr.add_argument("--text")
    pr.add_argument("--texts")
    pr.add_argument("--text-col", default="text")
    pr.add_argument("--out")
    c = sub.add_parser("textclf")
    c.add_argument("--merged", required=True)
    c.add_argument("--model", required=True)
    c.add_argument("--labels", type=int, default=3, choices=[3, 5])
    c.add_argument("--text")
    c.add_argument("--strict", action="store_true")
    for command in (b, t, c):
        command.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = p.parse_args(argv)

    existing = SparkSession.getActiveSession()
    spark = existing or SparkSession.builder.appName(f"slantspark-{args.cmd}").getOrCreate()
    if args.cmd == "build":
        arts = X.read_articles(spark, args.articles, args.mode, args.xml_errors)
        truth = X.read_truth(spark, args.truth, args.xml_errors)
        paths = DS.build_from(arts, truth, args.out, args.format, args.ids)
        spark.read.parquet(paths["profile"]).orderBy("check", "value").show(100, truncate=False)
        if args.xml_errors == "quarantine":
            bad = X.rejected_articles(spark, args.articles).unionByName(X.rejected_articles(spark, args.truth, "tags"))
            bad.write.mode("overwrite").parquet(f"{args.out}/rejected_xml")
    elif args.cmd == "train":
        from slantspark.plans.detector import Detector
        det = Detector().train(DS.read_table(spark, args.features, args.format, D.FEATURES_SCHEMA), fit_rows=args.fit_rows)
        summary, reports = det.test()
        summary.show(truncate=False)
        reports.show(100, truncate=False)
        det.save(args.models)
    elif args.cmd == "predict":
        from slantspark.plans.detector import Detector
        det = Detector.open(spark, args.models)
        if det is None:
            raise SystemExit(1)
        texts, col = _texts(spark, args)
        out = det.predict(texts, col)
        if args.out:
            out.write.mode("overwrite").parquet(args.out)
        else:
            out.select("result").show(truncate=False)
    elif args.cmd == "textclf":
        from slantspark.plans.text_classifier import TextClassifier
        merged = DS.read_table(spark, args.merged, args.format, D.MERGED_SCHEMA).na.fill("", subset=["bias"])
        clf = TextClassifier(n_labels=args.labels).train(merged, strict=args.strict)
        metrics, confusion, report = clf.evaluate()
        metrics.show(truncate=False)
        confusion.show(truncate=False)
        report.show(truncate=False)
        clf.save(args.model)
        if args.text is not None:
            clf.predict(D.literal_text(spark, args.text, "text")).select("predicted_label").show(truncate=False)
    if existing is None:
        spark.stop()


if __name__ == "__main__":
    main()
