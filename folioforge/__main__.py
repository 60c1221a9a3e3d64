"""``python -m folioforge scan|watch|export --config FILE``: one scan, a scan every poll interval, or the register as CSV."""

from __future__ import annotations

import argparse
import datetime
import logging

from pyspark.sql import SparkSession

from .operators import register
from .operators.model import OfflineModel
from .plans import intake
from .sources import files, staging
from .sources.chat import ChatModel
from .streaming import watch


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    parser.add_argument("command", choices=["scan", "watch", "export"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--model", choices=["offline", "chat"], default="offline")
    parser.add_argument("--profile", choices=["live", "full", "strict"], default="live")
    parser.add_argument("--reader", choices=["document", "plain"], default="document", help="how contents become pages: by what they hold, or as plain text")
    parser.add_argument("--to", help="folder of an export")
    given = parser.parse_args(argv)
    config = files.Config.from_json(given.config)
    config.make_folders()
    if config.log_dir:
        staging.log_to(config.log_dir)
    spark = SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    asked = ChatModel(config.model_url, config.model_name, config.model_timeout_seconds) if given.model == "chat" else OfflineModel()
    reader = files.document_pages if given.reader == "document" else files.plain_pages
    year = datetime.date.today().year
    if given.command == "scan":
        logging.getLogger(__name__).info("registered %d documents", intake.scan(spark, config, year, asked=asked, profile=given.profile, reader=reader))
    elif given.command == "watch":
        watch.watch(spark, config, year, f"{config.processing_dir}/.watch", asked=asked, profile=given.profile, reader=reader).awaitTermination()
    else:
        register.export_csv(spark, config.register_path, given.to or f"{config.register_path}-csv")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
