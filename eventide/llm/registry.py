"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import tidied
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op11_source_divergence
from .language import op5_language_id
from .licenses import ORACLE as LICENSES_SQL
from .licenses import op8_license_scans
from .maxscore import ORACLE as MAXSCORE_SQL
from .maxscore import op12_exact_top_k
from .media import op9_media_columns
from .neardup import ORACLE as NEARDUP_SQL
from .neardup import op6_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .periodic import op13_periodic_runs
from .quality import op7_quality_classifier
from .secrets import ORACLE as SECRETS_SQL
from .secrets import op3_secret_scans
from .segmentation import op1_sentencepiece_sampling
from .token_store import op2_token_id_output
from .vectors import ORACLE as VECTORS_SQL
from .vectors import op4_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: tidied(f) for f in (op1_sentencepiece_sampling, op2_token_id_output, op3_secret_scans, op4_embedding_near_dedup, op5_language_id, op6_ngram_jaccard_join, op7_quality_classifier, op8_license_scans, op9_media_columns, op10_best_fit_packing, op11_source_divergence, op12_exact_top_k, op13_periodic_runs)}
#: op4 and op6 reach a recall of their own choice; on the tables of a few hundred rows on which they are compared, they find all links.
ORACLES: dict[str, str] = {"op3_secret_scans": SECRETS_SQL, "op4_embedding_near_dedup": VECTORS_SQL, "op6_ngram_jaccard_join": NEARDUP_SQL, "op8_license_scans": LICENSES_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_exact_top_k": MAXSCORE_SQL}
