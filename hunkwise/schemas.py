"""Fixed schemas of the records that flow through the jobs."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, I, L, F32, F64, B = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.FloatType(),
    T.DoubleType(),
    T.BooleanType(),
)

# One row per webhook request: raw body and the three headers.
DELIVERY = _struct(
    delivery_id=S, event_type=S, signature=S, body=T.BinaryType(), received_at=L
)

REPOSITORY = _struct(full_name=S, clone_url=S)

PUSH_EVENT = _struct(
    ref=S,
    before=S,
    after=S,
    repository=REPOSITORY,
    commits=T.ArrayType(
        _struct(
            id=S,
            message=S,
            added=T.ArrayType(S),
            removed=T.ArrayType(S),
            modified=T.ArrayType(S),
            url=S,
        )
    ),
)

PULL_REQUEST_EVENT = _struct(
    action=S,
    pull_request=_struct(number=I, title=S, diff_url=S, head=_struct(sha=S, ref=S)),
    repository=REPOSITORY,
)

# The message on the bus; times are epoch milliseconds.
SNIPPET = _struct(
    code=S, repo=S, commit_sha=S, file_path=S, start_line=L, end_line=L, timestamp=L
)
SNIPPET_COLUMNS = SNIPPET.fieldNames()

DIFF = _struct(repo=S, commit_sha=S, diff=S)

RESULT = _struct(
    id=S,
    repo=S,
    commit_sha=S,
    file_path=S,
    start_line=L,
    end_line=L,
    code=S,
    is_anomalous=B,
    confidence=F32,
    label=S,
    latency_ms=F32,
    timestamp=L,
)
RESULT_COLUMNS = RESULT.fieldNames()
# A row of the results table; its partition columns come on top.
STORED_RESULT = T.StructType([*RESULT.fields, T.StructField("arrival", L)])

_METRICS = _struct(accuracy=F64, f1=F64, precision=F64, recall=F64)
HISTORY = _struct(epoch=I, train_loss=F64, val_loss=F64, train=_METRICS, val=_METRICS)
