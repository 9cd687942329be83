"""Small tables for the operators' tests."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None, langs=None, parts=3):
    rows = [(i, t, (langs or {}).get(i, "en"), sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)


def save(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
