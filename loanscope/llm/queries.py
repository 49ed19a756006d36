"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from .centroids import op13_centroids, op13_sql
from .hosts import op12_sql, op12_url_filter
from .language import op8_language_id
from .lattice import op2_sentencepiece
from .neardup import op7_near_duplicates
from .neighbours import op4_nearest
from .packing import op3_packing
from .periodic import op11_periodic_runs
from .privacy import op9_pii_surrogates
from .quality import op10_quality
from .sharding import op1_sharding
from .suffix import op6_suffix_dedup
from .tokens import op5_token_counts

QUERIES = {f.__name__: f for f in (op1_sharding, op2_sentencepiece, op3_packing, op4_nearest, op5_token_counts, op6_suffix_dedup, op7_near_duplicates,
                                  op8_language_id, op9_pii_surrogates, op10_quality, op11_periodic_runs, op12_url_filter, op13_centroids)}

#: Where SQL can express the result.
SQL: dict[str, str] = {"op12_url_filter": op12_sql(), "op13_centroids": op13_sql()}
