"""The engine's rules as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.functions import emails as E
from siftline.functions import names as N


def register(spark: SparkSession, words: N.Words | None = None, junk_domains: bool = True) -> list[str]:
    """Registers functions (Arrow batches) and the table function page_hits(url, html); returns their names."""
    held = words or N.Words()

    def each(f, kind: str):
        @F.pandas_udf(kind)
        def told(x):
            return x.map(lambda v: None if v is None else f(v))

        return told

    @F.pandas_udf("kind string, text string")
    def local_name(local, domain):
        import pandas as pd

        return pd.DataFrame([N.local_name(a or "", b or "", held) for a, b in zip(local, domain, strict=True)], columns=["kind", "text"])

    @F.pandas_udf("string")
    def name_from_local(local, domain):
        import pandas as pd

        return pd.Series([N.name_from_local(a or "", b or "", held) for a, b in zip(local, domain, strict=True)], dtype=object)

    @F.udtf(returnType="email string, name string, source string, name_from string")
    class PageHits:
        def eval(self, url: str, html: str):
            from siftline.operators import html as H

            for h in H.merge(H.candidates(H.parse(html), html, junk_domains), held) if html else ():
                yield h["email"], h["name"], h["source"], h["name_from"]

    functions = {
        "find_emails": each(E.find_in, "array<string>"), "clean_email": each(lambda x: E.clean_in(x, junk_domains), "string"), "deobfuscate": each(E.deobfuscate_in, "string"),
        "person_name": each(N.person_name, "string"), "business_name": each(N.business_name, "string"), "split_words": each(lambda x: N.split_words(x, held), "array<string>"),
        "name_from_domain": each(lambda x: N.name_from_domain(x, held), "string"), "name_from_local": name_from_local, "local_name": local_name,
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("page_hits", PageHits)
    return [*functions, "page_hits"]
