"""curata: article collection, deduplication, ranking, summaries and bounded tables on Spark.

Public entry points (all ``DataFrame -> DataFrame`` unless noted):

- sources:   ``curata.sources.feeds`` (parse_hn_items, hn_top_stories, parse_gnews, parse_reddit,
             parse_rss / parse_rss_rows, union_sources, hn_rejects, payload_rejects, read_landed,
             read_feed_files), ``curata.sources.landed.read_sources`` (a whole landing folder)
- functions: ``curata.functions`` (urls, text, scoring, summary: ``Column`` expressions)
- operators: ``curata.operators.dedup`` (dedup_url, drop_remembered, similar_pairs, dedup_titles,
             deduplicate), ``rank`` (score, cap_per_domain, top_n, rank), ``clean.clean_pages``,
             ``summarize`` (prompts, generate, resolve_summaries, to_news, encode_news),
             ``store`` (upsert, trim, remember, expire, latest_run, run_due, run_outcome)
- plans:     ``curata.plans.pipeline.run_batch`` (one run), ``curata.plans.job.run_job``
             (landing folder -> tables), ``curata.plans.views.register_views`` (SQL)
- streaming: ``curata.streaming.stream`` (stream_pipeline, url_dedup_stream)
"""
