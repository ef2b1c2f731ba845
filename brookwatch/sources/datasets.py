"""Published data sets as the standard text columns (timestamp, src_ip, label, attack_type, byte_len)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attack types by the data sets' own names.
CICDDOS = {
    "BENIGN": "normal", "DrDoS_DNS": "UDP_FLOOD", "DrDoS_LDAP": "UDP_FLOOD", "DrDoS_MSSQL": "UDP_FLOOD", "DrDoS_NTP": "UDP_FLOOD",
    "DrDoS_NetBIOS": "UDP_FLOOD", "DrDoS_SNMP": "UDP_FLOOD", "DrDoS_SSDP": "UDP_FLOOD", "DrDoS_UDP": "UDP_FLOOD", "Syn": "SYN_FLOOD",
    "UDP-lag": "UDP_FLOOD", "TFTP": "UDP_FLOOD", "WebDDoS": "HTTP_FLOOD", "Portmap": "SCAN_PROBE", "LDAP": "UDP_FLOOD",
    "MSSQL": "UDP_FLOOD", "NetBIOS": "UDP_FLOOD", "UDP": "UDP_FLOOD", "UDPLag": "UDP_FLOOD",
}
UNSW = {
    "Normal": "", "Fuzzers": "SCAN_PROBE", "Analysis": "SCAN_PROBE", "Backdoors": "UNKNOWN", "DoS": "UDP_FLOOD",
    "Exploits": "UNKNOWN", "Generic": "UNKNOWN", "Reconnaissance": "SCAN_PROBE", "Shellcode": "UNKNOWN", "Worms": "UNKNOWN",
}
BOT_CATEGORY = {"Normal": "", "DDoS": "UDP_FLOOD", "DoS": "UDP_FLOOD", "Reconnaissance": "SCAN_PROBE", "Theft": "UNKNOWN"}
BOT_SUBCATEGORY = {"TCP": "SYN_FLOOD", "UDP": "UDP_FLOOD", "HTTP": "HTTP_FLOOD", "Service_Scan": "SCAN_PROBE", "OS_Fingerprint": "SCAN_PROBE"}


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below a folder as text columns with trimmed names; our own results are passed over."""
    rows = spark.read.csv(folder, header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", inferSchema=False)
    rows = rows.filter(~F.contains(F.input_file_name(), F.lit("standardized")))
    return rows.toDF(*[c.strip() for c in rows.columns])


def _field(rows: DataFrame, names: tuple[str, ...], default: str) -> Column:
    """The first of the columns that rows has; a null field is empty."""
    for n in names:
        if n in rows.columns:
            return F.trim(F.coalesce(F.col(f"`{n}`"), F.lit("")))
    return F.lit(default)


def _mapped(name: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)


def _standard(rows: DataFrame, timestamp: Column, src_ip: Column, normal: Column, attack_type: Column, byte_len: Column) -> DataFrame:
    label = F.when(normal, "normal").otherwise("attack")
    kind = F.when(normal, "").otherwise(F.coalesce(attack_type, F.lit("UNKNOWN")))
    return rows.select(timestamp.alias("timestamp"), src_ip.alias("src_ip"), label.alias("label"), kind.alias("attack_type"), byte_len.alias("byte_len"))


def cicddos2019(rows: DataFrame) -> DataFrame:
    label = _field(rows, ("Label",), "")
    return _standard(rows, _field(rows, ("Timestamp",), ""), _field(rows, ("Source IP",), ""), label == "BENIGN", _mapped(label, CICDDOS), _field(rows, ("Total Length of Fwd Packets",), "0"))


def unsw_nb15(rows: DataFrame) -> DataFrame:
    """A blank category is a normal one."""
    category = _field(rows, ("attack_cat", "Attack_cat"), "Normal")
    category = F.when(category == "", "Normal").otherwise(category)
    normal = _field(rows, ("label", "Label"), "0") == "0"
    return _standard(rows, _field(rows, ("stime", "Stime"), "0"), _field(rows, ("srcip", "Srcip"), ""), normal, _mapped(category, UNSW), _field(rows, ("sbytes", "Sbytes"), "0"))


def bot_iot(rows: DataFrame) -> DataFrame:
    """The subcategory decides before the category."""
    category = _field(rows, ("category", "Category"), "Normal")
    subcategory = _field(rows, ("subcategory", "Subcategory"), "")
    normal = (_field(rows, ("attack", "Attack"), "0") == "0") | (category == "Normal")
    kind = F.coalesce(_mapped(subcategory, BOT_SUBCATEGORY), _mapped(category, BOT_CATEGORY))
    return _standard(rows, _field(rows, ("stime", "Stime"), "0"), _field(rows, ("saddr", "srcip"), ""), normal, kind, _field(rows, ("sbytes", "Sbytes"), "0"))
