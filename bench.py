"""Runs the headline queries once each and prints one line of JSON."""

import importlib.util
import json
import os
import time

HEADLINE = [
    "word_counts", "sentence_table", "fact_top_tokens", "length_coverage", "pool_funnel", "lexicon_counts", "lexicon_part_counts", "nearest_word", "near_words", "nested_spans", "damage_records", "repair_scores", "damage_plan",
    "draw_sample", "bootstrap_ci", "wilcoxon_ranks", "wrong_fact_rate", "holm_adjust", "first_per_group", "grid_means", "answer_parse", "html_unescape",
    "op1_suffix_dedup", "op2_quality_rules", "op3_ngram_jaccard_join", "op4_substring_dedup", "op5_url_filters", "op6_html_extract", "op7_packing", "op8_warc", "op9_decontaminate", "op10_toxicity", "pipeline",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")  # the tables are one file each
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, took = entry.queries(), {}
    for name in HEADLINE:
        if name in queries:
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
