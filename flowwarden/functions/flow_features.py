"""Flow event to feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.hashing import digest, digest_int
from flowwarden.schemas import CATEGORICAL, NUMERIC

# Protocol and TCP-flag vocabularies of the flow records, with their defaults.
PROTOCOLS = {"TCP": "tcp", "UDP": "udp", "ICMP": "icmp"}
STATES = {"SYN": "REQ", "SYN+ACK": "CON", "ACK": "CON", "FIN": "FIN", "RST": "RST", "PSH": "CON", "ICMP": "ECO"}
DEFAULT_PROTOCOL, DEFAULT_STATE = "tcp", "CON"
# Ranges of the fields an event does not carry.
TTL_RANGE, HOPS_RANGE, OFFSET_RANGE, SEQ_RANGE = (50, 255), (1, 20), (1000, 200000), (0, 999999)


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def protocol_name(protocol: Column) -> Column:
    return _lookup(F.upper(protocol), PROTOCOLS, DEFAULT_PROTOCOL)


def connection_state(tcp_flags: Column) -> Column:
    return _lookup(tcp_flags, STATES, DEFAULT_STATE)


def flow_features(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Project flow events to the 48 feature fields (plus ``keep``).

    TTLs, hop counts and offset are not part of an event: existing columns are used, otherwise a fixed
    draw from the record's usual range, so that one event always gets one vector.
    """
    h = digest(F.col("src_ip"), F.col("dst_ip"), F.col("timestamp"))
    duration, packets, size = F.col("duration"), F.col("packets_count"), F.col("bytes_count")
    floor = F.greatest(duration, F.lit(0.001))
    one = F.lit(1).cast("bigint")

    def half(x: Column) -> Column:
        return F.shiftright(x.cast("bigint"), 1)

    def drawn(name: str, bounds: tuple[int, int], start: int, digits: int) -> Column:
        if name in df.columns:
            return F.col(name)
        low, high = bounds
        return F.lit(low) + F.pmod(digest_int(F.col("_h"), start, digits), F.lit(high - low + 1))

    proto = protocol_name(F.col("protocol"))
    mean_size = size / F.greatest(packets, one)
    zero = F.lit(0.0)
    fields = {
        "Seq": drawn("Seq", SEQ_RANGE, 1, 8),
        **{c: duration for c in ("Dur", "RunTime", "Mean", "Sum", "Min", "Max")},
        "Proto": proto,
        "sTos": F.lit("0.0"), "dTos": F.lit("0.0"), "sDSb": F.lit("cs0"), "dDSb": F.lit("cs0"),
        "sTtl": drawn("sTtl", TTL_RANGE, 9, 4), "dTtl": drawn("dTtl", TTL_RANGE, 13, 4),
        "sHops": drawn("sHops", HOPS_RANGE, 17, 4), "dHops": drawn("dHops", HOPS_RANGE, 21, 4),
        "Cause": F.lit("Start"), "State": connection_state(F.col("tcp_flags")),
        "TotPkts": packets, "SrcPkts": F.greatest(one, half(packets)),
        "DstPkts": F.greatest(one, packets - half(packets)),
        "TotBytes": size, "SrcBytes": F.greatest(one, half(size)), "DstBytes": F.greatest(one, size - half(size)),
        "Offset": drawn("Offset", OFFSET_RANGE, 25, 8),
        "sMeanPktSz": mean_size, "dMeanPktSz": mean_size,
        **{c: zero for c in ("Load", "SrcLoad", "DstLoad", "Loss", "SrcLoss", "DstLoss", "pLoss", "SrcGap", "DstGap")},
        "Rate": size / floor, "SrcRate": (size / 2) / floor, "DstRate": (size / 2) / floor,
        **{c: zero for c in ("SrcWin", "DstWin", "sVid", "dVid", "SrcTCPBase", "DstTCPBase")},
        "TcpRtt": F.when(proto == "tcp", duration * 1000).otherwise(zero),
        "SynAck": zero,
        "AckDat": F.when(proto == "tcp", size.cast("double")).otherwise(zero),
    }
    return df.withColumn("_h", h).select(*keep, *[c.alias(n) for n, c in fields.items()])


def feature_row(source: Column, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL) -> list[Column]:
    """Columns from a ``map<string,string>`` of partial features: bad or absent numbers 0, categories unknown."""
    numbers = [F.coalesce(source[c].try_cast("double"), F.lit(0.0)).alias(c) for c in numeric]
    texts = [F.coalesce(source[c], F.lit("unknown")).alias(c) for c in categorical]
    return numbers + texts
