"""DuckDB oracle SQL for the text operators (tokens, n-grams, vocabulary,
TF-IDF). Mirrors labelsift.operators.tfidf; used only by ``oracle_sql()``."""

from __future__ import annotations

from labelsift.operators.tfidf import TfidfConfig


def _stop_list(cfg: TfidfConfig) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in cfg.stop_words)


def terms_sql(source: str, cfg: TfidfConfig, key: str = "row_id", text: str = "text") -> str:
    """``(key, term)`` rows, one per term occurrence."""
    stop = f"WHERE t NOT IN ({_stop_list(cfg)})" if cfg.stop_words else ""
    uni = f"""
      a AS (SELECT {key} AS k, regexp_extract_all(lower(coalesce(CAST({text} AS VARCHAR), '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS arr
            FROM ({source})),
      u AS (SELECT k, unnest(arr) AS t, generate_subscripts(arr, 1) AS pos FROM a),
      f AS (SELECT k, t, pos FROM u {stop})"""
    if cfg.ngram_max <= 1:
        body = "SELECT k, t AS term FROM f"
    else:
        body = """SELECT k, t AS term FROM f
      UNION ALL
      SELECT k, t || ' ' || nxt AS term
      FROM (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY pos) AS nxt FROM f) WHERE nxt IS NOT NULL"""
    return f"WITH {uni.strip()} {body}"


def term_counts_sql(source: str, cfg: TfidfConfig, key: str = "row_id", text: str = "text") -> str:
    return f"SELECT k AS {key}, term, count(*) AS tf FROM ({terms_sql(source, cfg, key, text)}) GROUP BY k, term"


def doc_freq_sql(source: str, cfg: TfidfConfig, key: str = "row_id", text: str = "text") -> str:
    return (f"SELECT term, count(*) AS df, sum(tf) AS ctf FROM "
            f"({term_counts_sql(source, cfg, key, text)}) GROUP BY term")


def vocab_sql(source: str, cfg: TfidfConfig, key: str = "row_id", text: str = "text") -> str:
    """``(term, idx, df, ctf, idf)`` of a vocabulary fitted on ``source``."""
    lo = cfg.min_df if isinstance(cfg.min_df, int) else f"{cfg.min_df!r} * n"
    hi = cfg.max_df if isinstance(cfg.max_df, int) else f"{cfg.max_df!r} * n"
    lim = f"ORDER BY ctf DESC, term LIMIT {cfg.max_features}" if cfg.max_features else ""
    return f"""
      SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, ctf,
             ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
      FROM (SELECT s.*, nn.n FROM ({doc_freq_sql(source, cfg, key, text)}) s,
                                  (SELECT count(*) AS n FROM ({source})) nn
            WHERE df >= {lo} AND df <= {hi} {lim})"""


def tfidf_sql(fit_source: str, cfg: TfidfConfig, apply_source: str | None = None,
              key: str = "row_id", text: str = "text") -> str:
    """``(key, term, weight)`` for ``apply_source`` with a vocabulary fitted on
    ``fit_source`` (T9 when they differ)."""
    apply_source = apply_source or fit_source
    tf = "CAST(c.tf AS DOUBLE)" if not cfg.sublinear_tf else "(1.0 + ln(c.tf))"
    return f"""
      SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
      FROM (SELECT c.{key}, c.term, {tf} * v.idf AS w
            FROM ({term_counts_sql(apply_source, cfg, key, text)}) c
            JOIN ({vocab_sql(fit_source, cfg, key, text)}) v USING (term))"""
