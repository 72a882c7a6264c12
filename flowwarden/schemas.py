"""Column lists, taxonomy and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The column layout of a flow record.
FLOW_COLUMNS = [
    "", "Seq", "Dur", "RunTime", "Mean", "Sum", "Min", "Max", "Proto", "sTos", "dTos", "sDSb", "dDSb",
    "sTtl", "dTtl", "sHops", "dHops", "Cause", "TotPkts", "SrcPkts", "DstPkts", "TotBytes", "SrcBytes",
    "DstBytes", "Offset", "sMeanPktSz", "dMeanPktSz", "Load", "SrcLoad", "DstLoad", "Loss", "SrcLoss",
    "DstLoss", "pLoss", "SrcGap", "DstGap", "Rate", "SrcRate", "DstRate", "State", "SrcWin", "DstWin",
    "sVid", "dVid", "SrcTCPBase", "DstTCPBase", "TcpRtt", "SynAck", "AckDat", "Label", "Attack Type",
    "Attack Tool",
]
CATEGORICAL = ["Proto", "sTos", "dTos", "sDSb", "dDSb", "Cause", "State"]
LABELS = ["Label", "Attack Type", "Attack Tool"]
LEGACY_CATEGORICAL = ["Proto", "sDSb", "dDSb", "Cause", "State"]
NUMERIC = [c for c in FLOW_COLUMNS if c not in ("", "Seq", *CATEGORICAL, *LABELS)]
LEGACY_NUMERIC = ["Seq", "sTos", "dTos"] + [
    c for c in NUMERIC if c not in ("sVid", "dVid", "SrcGap", "DstGap", "SrcTCPBase", "DstTCPBase")
]
REQUIRED_COLUMNS = ["Proto", "TotPkts", "TotBytes", "Dur"]

# Traffic classes, alphabetical; also the tie order between attack classes.
BENIGN = "benign"
ATTACK_CLASSES = [
    "httpflood", "icmpflood", "slowratedos", "synflood", "synscan", "tcpconnectscan", "udpflood", "udpscan",
]
TRAFFIC_CLASSES = [BENIGN, *ATTACK_CLASSES]

INDEX_COLUMN = "row_index"
CORRUPT_COLUMN = "corrupt_record"


def flow_csv_schema() -> T.StructType:
    """Read schema of one flow CSV: everything text, so that bad numbers reach the cleaning step."""
    names = [INDEX_COLUMN if c == "" else c for c in FLOW_COLUMNS]
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT_COLUMN]])


FLOW_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("bytes_count", T.LongType()),
        T.StructField("packets_count", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("tcp_flags", T.StringType()),
    ]
)

ANALYSIS_LISTS = ["immediate_actions", "investigation_steps", "prevention_measures"]
ANALYSIS_TEXTS = ["attack_vector", "potential_impact", "technical_analysis"]
ANALYSIS = T.StructType(
    [
        T.StructField("threat_level", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("attack_vector", T.StringType()),
        T.StructField("potential_impact", T.StringType()),
        T.StructField("immediate_actions", T.ArrayType(T.StringType())),
        T.StructField("investigation_steps", T.ArrayType(T.StringType())),
        T.StructField("prevention_measures", T.ArrayType(T.StringType())),
        T.StructField("technical_analysis", T.StringType()),
        T.StructField("rag_assisted", T.BooleanType()),
        T.StructField("response_source", T.StringType()),
    ]
)

HISTORY_METADATA = T.StructType(
    [
        T.StructField("attack_type", T.StringType()),
        T.StructField("threat_level", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("total_packets", T.LongType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("analysis_source", T.StringType()),
    ]
)
HISTORY_DOCUMENT = T.StructType(
    [
        T.StructField("doc_index", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", HISTORY_METADATA),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("ts", T.TimestampType()),
    ]
)

_PARSED = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "risk_score" else f.dataType)
        for f in ANALYSIS.fields
    ]
    + [
        T.StructField(n, T.StringType())
        for n in ("question", "answer", "original_analysis_id", "timestamp", "inference_time", "model_name",
                  "analysis_timestamp", "inference_method", "full_response_length")
    ]
)
# Superset of the two log layouts; a layout's missing fields read as null.
RESPONSE_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("request_type", T.StringType()),
        T.StructField("flow_id", T.StringType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("prompt_length", T.LongType()),
        T.StructField("response_length", T.LongType()),
        T.StructField("full_response", T.StringType()),
        T.StructField("response_source", T.StringType()),
        T.StructField("parsed_result", _PARSED),
        T.StructField("model_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("total_analyses", T.LongType()),
        T.StructField("total_questions", T.LongType()),
        T.StructField("analysis_number", T.LongType()),
    ]
)
