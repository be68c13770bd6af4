"""Plans: whole analyses composed of operators, and the registered queries with their SQL."""

from . import cell_queries, image_queries, outline_queries, sheet_queries, stream_queries, study_queries, trace_queries, volume_queries
from .registry import QUERIES, SQL

flagship = QUERIES["peak_isi_cv"]
