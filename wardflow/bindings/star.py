"""Clinic-shaped tables derived from the star schema.

Each table is a projection of one base table, written once as SQL expressions
that mean the same in Spark and in the checking engine.  ``Shamsi`` marks date
expressions that become Solar Hijri text; the two sides compute it differently.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.dates import to_shamsi
from wardflow.sources.calendar import build_calendar
from wardflow.sources.tables import ParquetTables

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
CALENDAR_SPAN = ("1990-01-01", "2029-12-31")


class Shamsi(str):
    """Date expression whose value is stored as Solar Hijri text."""


def clock(ts: str) -> str:
    return (
        f"lpad(CAST(hour({ts}) AS STRING), 2, '0') || ':' || "
        f"lpad(CAST(minute({ts}) AS STRING), 2, '0')"
    )


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def amounts(k: str) -> dict[str, str]:
    """Six tariff amounts, each missing for part of the rows."""
    return {
        "ConstantBefor": f"nullif({k} % 3, 0) * 10",
        "PercentBefor": f"nullif({k} % 4, 1) + 20",
        "LimmitBefor": f"nullif({k} % 5, 2) * 7",
        "ConstantAfter": f"nullif({k} % 4, 0) * 11",
        "PercentAfter": f"nullif({k} % 3, 2) + 30",
        "LimmitAfter": f"nullif({k} % 2, 1) + 5",
    }


def lines(k: str) -> str:
    return (
        f"CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' "
        f"WHEN 2 THEN 'Street ' || {text(k)} || chr(10) || ' floor 2 ' || chr(10) "
        f"WHEN 3 THEN ' only line ' ELSE 'a' || chr(10) || chr(10) || 'c' || chr(13) || chr(10) "
        f"|| '  d ' || {text(k)} || chr(10) || 'e' END"
    )


# name -> (base table, row condition or None, columns)
TABLES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "files": (
        "orders",
        None,
        {
            "siFiles": "o_orderkey",
            "FileID": "o_orderkey + 1000",
            "FName": f"CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'F' || {text('o_custkey % 97')} END",
            "LName": f"'L' || {text('o_orderkey % 389')}",
            "Phone1": f"CASE o_custkey % 3 WHEN 0 THEN '0912' || {text('o_orderkey % 100000')} "
            f"WHEN 1 THEN '021;' || {text('o_orderkey % 1000')} ELSE NULL END",
            "Phone2": f"CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '021' || {text('o_custkey')} ELSE NULL END",
            "RefPlace": f"'Ward ' || {text('o_custkey % 25')}",
            "PaidAfter": "CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END",
            "BirthYear": text("1330 + o_custkey % 60"),
            "ReferDate": Shamsi("CAST(o_orderdate AS DATE)"),
            "Subject": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
            "Comment": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority || ' ' || o_orderstatus END",
            "Address": f"'Street ' || {text('o_custkey % 50')}",
            "Age": "o_custkey % 90",
            "SendType": "CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END",
            "DoctorName": f"'D' || {text('o_custkey')}",
            "Job": f"CASE o_custkey % 3 WHEN 0 THEN 'surgeon' WHEN 1 THEN 'dentist' ELSE NULL END",
            "siDoctor": "o_custkey",
            "RefFileID": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 + 1000 END",
            "siHospital": "o_custkey % 25",
            "Bef_Aft": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
            "Sex": "o_custkey % 2",
            "PathFolder": f"'//store/p' || {text('o_orderkey % 5')}",
            "siBranch": "o_custkey % 5 + 1",
            "Is3D": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END",
            "HasFilterList": "CASE WHEN o_orderkey % 9 = 0 THEN 1 END",
            "IsScanned": "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END",
            "Thumb": "o_orderpriority || o_orderstatus || o_orderpriority",
        },
    ),
    "doctors": (
        "customer",
        None,
        {
            "siDoctors": "c_custkey",
            "FileID": "c_custkey + 500000",
            "FName": f"CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'کیان ' || {text('c_custkey % 50')} END",
            "LName": f"CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'D' || {text('c_custkey')} END",
            "Job": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END",
            "Comment": lines("c_custkey"),
            "Address1": "CASE WHEN c_custkey % 3 = 0 THEN c_name END",
            "Tag1": "c_custkey % 4",
            "PerDiscount": "c_custkey % 130",
            "SumAfter": "c_custkey % 9",
            "FolderName": f"CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'doc' || {text('c_custkey')} END",
            "MedicalID": f"CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {text('c_custkey + 100')} END",
            "EMail1": f"CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' d' || {text('c_custkey')} || '@mail.example ' END",
            "EMail2": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'x@mail.example' END",
            "SMS1": "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE '0912' END",
            "SMS2": "CASE c_custkey % 2 WHEN 0 THEN NULL ELSE '' END",
            "IsActiveEMail": "nullif(c_custkey % 3, 2)",
            "IsActiveSMS": "c_custkey % 2",
            "TelegramClinic": f"CASE c_custkey % 4 WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE '@d' || {text('c_custkey')} END",
            "IsActiveTelegClinic": "nullif((c_custkey + 1) % 3, 2)",
            "TelegramLab": f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '@lab' || {text('c_custkey')} END",
            "IsActiveTelegLab": "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END",
            "EMailLab1": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'lab@mail.example' END",
            "EMailLab2": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'lab2@mail.example' END",
            "IsActiveEmailLab": "nullif(c_custkey % 4, 3)",
            "IsAuto": "nullif(c_custkey % 5 % 3, 0) - 1",
            "IsOwnDoc": "c_custkey % 2",
            "Description": "c_mktsegment || ' ' || c_name",
            "Filter": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PROMO, LARGE ,,' WHEN 2 THEN '' ELSE ' SMALL' END",
        },
    ),
    "hospitals": (
        "nation",
        None,
        {
            "siHospital": "n_nationkey",
            "FullName": "n_name",
            "Type": "n_nationkey % 2",
            "Location": "n_nationkey % 3 % 2",
            "ForceAfter": "nullif(n_nationkey % 2, 0)",
            **amounts("n_nationkey"),
            "Comment": "n_name",
            "SeqNO": "25 - n_nationkey",
        },
    ),
    "private_tariffs": (
        "customer",
        "c_acctbal < 3000",
        {
            "siPrivateTariff": "c_custkey + 70000",
            "siDoctors": "c_custkey",
            "ForceAfter": "nullif(c_custkey % 3, 1)",
            **amounts("c_custkey"),
            "Comment": "c_mktsegment",
        },
    ),
    "branches": ("region", None, {"siBranch": "r_regionkey + 1", "BranchName": "r_name"}),
    "paths": (
        "region",
        None,
        {
            "NetworkPath": f"'//store/p' || {text('r_regionkey')}",
            "LocalPath": f"'D:/p' || {text('r_regionkey')}",
        },
    ),
    "tariffs": (
        "part",
        None,
        {
            "siCommonTariff": "p_partkey",
            "TariffName": "p_name",
            "Price": "CAST(floor(p_retailprice) AS BIGINT)",
            "Type": "p_size % 3",
            "TariffClass": "p_size % 4",
            "IsAfter": "p_size % 2",
            "Countable": "CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END",
            "Comment": "p_type",
            "Disabled": "CASE WHEN p_brand = 'Brand#7' THEN 1 END",
            "SeqNO": "p_partkey % 100",
            "ExtraPercent": "nullif(p_size % 5, 0) * 9",
            "ForceExtra": "CASE WHEN p_size = 1 THEN 1 ELSE 0 END",
        },
    ),
    "services": (
        "lineitem",
        None,
        {
            "siServiceTable": f"{text('l_orderkey')} || '-' || {text('l_linenumber')} || '-' || {text('l_partkey')} || '-' || {text('l_suppkey')}",
            "siFiles": "l_orderkey",
            "siWait": "l_orderkey",
            "siCommonTariff": "l_partkey",
            "Number": "nullif(CAST(floor(l_quantity) AS BIGINT) % 10, 0)",
            "Type": "l_linenumber % 2",
            "UsedTariffName": "l_returnflag",
            "UsedPrice": "CAST(floor(l_extendedprice) AS BIGINT)",
        },
    ),
    "accounts": (
        "orders",
        None,
        {
            "siAccount": "o_orderkey + 300000",
            "siFiles": "o_orderkey",
            "siDiscount": "nullif(o_orderkey % 6, 0)",
            "PerDiscount": "o_orderkey % 6 * 5",
            "Discount": "CAST(floor(o_totalprice) AS BIGINT) % 100",
            "FactorDate": Shamsi("CAST(o_orderdate AS DATE)"),
            "DiscountTitle": f"'title ' || {text('o_orderkey % 6')}",
            "TotalPrice": "CAST(floor(o_totalprice) AS BIGINT)",
            "PayableFee": "CAST(floor(o_totalprice) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) % 100",
            "PaidAmount": "CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) - 500 ELSE 1000 END",
            "RemainAmount": "CASE WHEN o_orderstatus = 'F' THEN 500 ELSE CAST(floor(o_totalprice) AS BIGINT) - 1000 END",
            "RoundAmount": "CAST(floor(o_totalprice) AS BIGINT) % 10",
            "PaidDate": Shamsi(
                "CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN CAST(o_orderdate AS DATE) + 10 "
                "ELSE CAST(o_orderdate AS DATE) END"
            ),
            "Type": "o_custkey % 3",
            "Comment": "o_orderpriority",
            "IsExtra": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END",
        },
    ),
    "discounts": (
        "region",
        None,
        {"siDiscount": "r_regionkey + 1", "Title": "r_name", "PerDiscount": "r_regionkey * 60", "Comment": "r_name"},
    ),
    "waits": (
        "events",
        None,
        {
            "siWait": "event_id",
            "siFiles": "user_id",
            "WaitDate": Shamsi("CAST(ts AS DATE)"),
            "WaitTime": clock("ts"),
            "WaitTimeOut": clock("(ts + INTERVAL '45' MINUTE)"),
            "SurgStatus": "event_id % 2",
            "Status": "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END",
            "Comment": "props",
            "WaitCheck": f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {clock('(ts + INTERVAL ' + chr(39) + '5' + chr(39) + ' MINUTE)')} END",
            "WaitCall": f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE {clock('ts')} END",
            "WaitPhoto": f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {clock('ts')} END",
            "WaitService": f"CASE WHEN event_id % 6 = 0 THEN NULL ELSE {clock('ts')} END",
            "MachineCheck": f"CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'M' || {text('user_id % 8')} END",
            "MachinePhoto": f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'P' || {text('user_id % 6')} END",
            "Edited": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END",
            "Printed": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END",
            "SentEMail": "nullif(event_id % 5, 4)",
            "EMailDate": Shamsi("CASE WHEN event_id % 5 IN (2, 3) THEN CAST(ts AS DATE) END"),
            "EMailTime": f"CASE WHEN event_id % 5 IN (2, 3) THEN {clock('ts')} END",
            "AttachedCount": "event_id % 7",
            "AttachedCountTeleg": "nullif(event_id % 6, 0)",
            "SentSMS": "nullif(event_id % 4, 0)",
            "SentSMSTime": "CASE WHEN event_id % 4 = 1 THEN ts END",
            "FactorStatus": "event_id % 3",
            "TelegramStatus": "nullif(event_id % 7, 6)",
            "TelegMessageId": "nullif(event_id % 3, 0)",
            "TryCount": "nullif(event_id % 13, 0)",
            "SendDate": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '2' HOUR END",
            "ManualTelegDate": "CASE WHEN event_id % 6 = 1 THEN ts + INTERVAL '3' HOUR END",
            "ManualTelegStatus": "nullif(event_id % 6, 3)",
        },
    ),
    "waits_3d": (
        "orders",
        "o_orderpriority = '3-MEDIUM'",
        {
            "siWait3D": "o_orderkey + 90000",
            "siFiles": "o_orderkey",
            "Status": "CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 16 ELSE 20 END",
            "LastStatus": "CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 10 ELSE 16 END",
            "DeliveryTime": "o_orderdate",
            "TakePhoto": "CASE WHEN o_custkey % 5 > 0 THEN o_orderdate + INTERVAL '1' HOUR END",
            "DenseCloudTime": "CASE WHEN o_custkey % 5 > 1 THEN o_orderdate + INTERVAL '2' HOUR END",
            "PaidTime": "CASE WHEN o_custkey % 5 > 2 THEN o_orderdate + INTERVAL '3' HOUR END",
            "Object3DTime": "CASE WHEN o_custkey % 5 > 3 THEN o_orderdate + INTERVAL '4' HOUR END",
        },
    ),
    "albums": (
        "orders",
        "o_orderstatus <> 'O'",
        {
            "siAlbum": "o_orderkey",
            "siFiles": "o_orderkey",
            "AlbumName": f"'album ' || {text('o_custkey % 30')}",
            "AlbumDate": Shamsi("CAST(o_orderdate AS DATE)"),
            "SurgDate": Shamsi("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END"),
            "Comment": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus || ' ' || o_orderpriority END",
            "AssurList": f"'A' || {text('o_custkey % 40')}",
            "Remain": "nullif(o_orderkey % 10, 3) - 2",
        },
    ),
    "album_procedures": (
        "lineitem",
        None,
        {"siAlbum": "l_orderkey", "siSurgery": "l_partkey"},
    ),
    "procedures": (
        "part",
        None,
        {
            "siSurgery": "p_partkey",
            "SurgeryName": "' ' || p_type",
            "LatinName": "p_name",
            "Sequent": "p_size",
            "Show": "CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END",
        },
    ),
    "visit_documents": (
        "documents",
        None,
        {
            "siDocument": "doc_id",
            "siAlbum": "doc_id",
            "TypeNumber": "n_chars % 12",
            "Title": "lang",
            "Path": "source",
            "Comment": "text",
            "siPage": "nullif(doc_id % 5, 0)",
            "CheckValue": f"CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN {text('n_chars % 2')} "
            f"ELSE {text('n_chars % 2')} || {text('doc_id % 2')} || {text('n_chars % 3 % 2')} END",
        },
    ),
    "receipts": (
        "orders",
        None,
        {
            "siFiles": "o_orderkey",
            "BackColor": "nullif(o_orderkey % 6, 5)",
            "LifeSize": "nullif(o_custkey % 3, 2)",
            "GridLine": "nullif(o_orderkey % 3, 2)",
            "A": text("o_custkey % 90"),
            "B": text("o_orderkey % 90"),
            "C": text("(o_orderkey + o_custkey) % 90"),
            "Comment1": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END",
            "Comment2": "o_orderstatus",
        },
    ),
    "receipt_titles": (
        "supplier",
        None,
        {
            "siReceipt": text("s_suppkey"),
            "Title": "s_name",
            "PhotoTitle": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'photo ' || s_name END",
            "EditorTitle": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'edit ' || s_name END",
        },
    ),
    "lab_doctors": (
        "customer",
        None,
        {
            "fCode": "c_custkey",
            "fFirstName": f"CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'كيان ' || {text('c_custkey % 50')} END",
            "fLastName": f"CASE WHEN c_custkey % 3 = 1 THEN 'D ' ELSE 'D' END || {text('c_custkey')}",
            "fMedicalNo": f"CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {text('c_custkey + 100')} END",
            "fCodeSpecialty": "nullif(c_custkey % 6, 5)",
        },
    ),
    "lab_specialties": ("region", None, {"fCode": "r_regionkey", "fName": "r_name"}),
    "lab_acceptances": (
        "orders",
        "o_orderstatus <> 'F'",
        {
            "fCode": "o_orderkey + 7000000",
            "fCodeDoctor": "o_custkey",
            "fFirstName": f"'F' || {text('o_orderkey % 97')}",
            "fLastName": f"'L' || {text('o_orderkey % 389')}",
            "fMobile": f"'0912' || {text('o_orderkey')}",
            "fEmergency": "nullif(o_orderkey % 3, 2)",
            "fBirthDate": f"{text('1330 + o_custkey % 60')} || '/01/01'",
            "fDateTime": "o_orderdate",
            "fAcceptionDate": Shamsi("CAST(o_orderdate AS DATE)"),
            "fAcceptionDateTime": "o_orderdate + (o_orderkey % 600) * INTERVAL '1' MINUTE",
            "fSex": "o_custkey % 2",
            "fCancellation": "CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END",
            "fPutAnswer": "o_custkey % 2",
            "ReAccept": "CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END",
        },
    ),
    "lab_patients": (
        "orders",
        "o_orderstatus = 'P'",
        {
            "FileID": "o_orderkey + 1000",
            "fCode": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey + 7000000 END",
            "FName": f"'F' || {text('o_orderkey % 97')}",
            "LName": f"'L' || {text('o_orderkey % 389')}",
            "Mobile": f"CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE '0912' || {text('o_orderkey')} END",
            "Phone1": f"CASE WHEN o_custkey % 4 = 0 THEN '021' || {text('o_orderkey')} END",
            "SendType": "o_custkey % 2",
            "SendStatus": "CASE o_custkey % 2 WHEN 0 THEN 'اورژانس' ELSE 'عادي' END",
            "BirthYear": text("1330 + o_custkey % 60"),
            "MedicalID": text("o_custkey % 1000"),
            "Sex": "o_custkey % 2",
            "SexTitle": "CASE o_custkey % 2 WHEN 0 THEN 'زن' ELSE 'مرد' END",
            "MiladiDate": "CAST(o_orderdate AS DATE)",
            "ReferDate": Shamsi("CAST(o_orderdate AS DATE)"),
            "DoctorName": f"'D' || {text('o_custkey')}",
            "siDoctor": "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END",
            "AutoStatus": "nullif(o_orderkey % 3, 0)",
            "Status": "o_orderkey % 4",
            "RegisterDate": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '9' HOUR END",
            "AnswerDate": "CASE WHEN o_orderkey % 4 = 3 THEN o_orderdate + INTERVAL '15' HOUR END",
            "TelegramStatus": "nullif(o_custkey % 7, 6)",
            "TelegMessageId": "nullif(o_custkey % 3, 0)",
            "TryCount": "nullif(o_custkey % 12, 0)",
            "SendDate": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '20' HOUR END",
            "SentEMailLab": "nullif(o_custkey % 5, 4)",
            "SentEMailLabTime": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '21' HOUR END",
        },
    ),
    "deletion_log": (
        "orders",
        "o_orderpriority = '4-NOT SPECIFIED'",
        {"FileID": "o_orderkey + 1000", "Status": "o_custkey % 11", "LogDate": "o_orderdate"},
    ),
    "access_log": (
        "events",
        None,
        {
            "siPermission": "event_id",
            "LoginName": f"'u' || {text('user_id')}",
            "siFile": "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END",
            "Status": "event_type",
            "ActionTime": "ts",
        },
    ),
    "account_log": (
        "orders",
        "o_orderpriority = '1-URGENT'",
        {
            "siAccount": "o_orderkey + 300000",
            "siFiles": "o_orderkey",
            "PayableFee": "CAST(floor(o_totalprice) AS BIGINT)",
            "PaidAmount": "0",
            "LogDateTime": "o_orderdate",
            "LogType": "o_orderstatus",
        },
    ),
    "service_log": (
        "lineitem",
        "l_returnflag = 'R'",
        {
            "siAccount": "l_orderkey + 300000",
            "siFiles": "l_orderkey",
            "siWait": "l_orderkey",
            "siCommonTariff": "l_partkey",
            "Number": "CAST(floor(l_quantity) AS BIGINT) % 10",
            "UsedPrice": "CAST(floor(l_extendedprice) AS BIGINT)",
        },
    ),
    "step_events": (
        "events",
        None,
        {
            "siFiles": "user_id",
            "seq": "event_id",
            "step": "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 WHEN 'signup' THEN 10 WHEN 'purchase' THEN 16 ELSE 20 END",
            "undo": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END",
            "at": "ts",
        },
    ),
}


class StarTables(Mapping):
    """Base tables, clinic tables and the calendar by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.base = ParquetTables(spark, folder)
        self.open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.open:
            self.open[name] = self._derive(name)
        return self.open[name]

    def _derive(self, name: str) -> DataFrame:
        if name == "calendar":
            return build_calendar(self.spark, *CALENDAR_SPAN)
        if name in BASE_TABLES:
            return self.base[name]
        source, cond, cols = TABLES[name]
        df = self[source]
        if cond is not None:
            df = df.where(cond)
        df = df.selectExpr(*[f"{e} AS `{c}`" for c, e in cols.items()])
        days = [c for c, e in cols.items() if isinstance(e, Shamsi)]
        return df.withColumns({c: to_shamsi(F.col(c)) for c in days}) if days else df

    def __iter__(self):
        return iter([*BASE_TABLES, *TABLES, "calendar"])

    def __len__(self):
        return len(BASE_TABLES) + len(TABLES) + 1


# The calendar of the checking SQL walks the leap years one by one, so it does
# not share the closed formula used on the Spark side.
CALENDAR_SQL = {
    "cal_years": (
        "SELECT y, 365 + CASE WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 1 ELSE 0 END AS len "
        "FROM range(1, 1500) AS r(y)"
    ),
    "cal_starts": "SELECT y, len, CAST(sum(len) OVER (ORDER BY y) AS BIGINT) - len AS before FROM cal_years",
    "cal_days": (
        "SELECT CAST(i AS INT) AS ID, DATE '{0}' + CAST(i AS INT) AS MiladiDate, "
        "(DATE '{0}' - DATE '1900-01-01') + CAST(i AS INT) + 466702 AS n "
        "FROM range(0, (DATE '{1}' - DATE '{0}') + 1) AS r(i)"
    ).format(*CALENDAR_SPAN),
    "cal_doy": (
        "SELECT ID, MiladiDate, y, n - before AS doy FROM cal_days "
        "JOIN cal_starts ON n > before AND n <= before + len"
    ),
    "cal_parts": (
        "SELECT ID, MiladiDate, y, CASE WHEN doy <= 186 THEN (doy - 1) // 31 + 1 ELSE (doy - 187) // 30 + 7 END AS m, "
        "CASE WHEN doy <= 186 THEN (doy - 1) % 31 + 1 ELSE (doy - 187) % 30 + 1 END AS d FROM cal_doy"
    ),
    "calendar": (
        "SELECT ID, MiladiDate, strftime(MiladiDate, '%Y/%m/%d') AS Miladi, "
        "CAST(y AS STRING) || '/' || lpad(CAST(m AS STRING), 2, '0') || '/' || lpad(CAST(d AS STRING), 2, '0') AS Shamsi, "
        "CAST(d AS INT) AS DayInMonth, CAST((dayofweek(MiladiDate) + 1) % 7 + 1 AS INT) AS DayInWeek FROM cal_parts"
    ),
}


def _table_sql(name: str) -> str:
    source, cond, cols = TABLES[name]
    exprs = []
    for c, e in cols.items():
        if isinstance(e, Shamsi):
            e = f"(SELECT Shamsi FROM calendar AS k WHERE k.MiladiDate = {e})"
        exprs.append(f'{e} AS "{c}"')
    where = f" WHERE {cond}" if cond else ""
    return f"SELECT {', '.join(exprs)} FROM {source}{where}"


def with_tables(body: str) -> str:
    """SQL text preceded by the clinic tables it mentions."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", body)]
    ctes = {n: _table_sql(n) for n in used}
    if re.search(r"\bcalendar\b", body + " ".join(ctes.values())):
        ctes = {**CALENDAR_SQL, **ctes}
    if not ctes:
        return body.strip()
    head = ",\n".join(f"{n} AS ({q})" for n, q in ctes.items())
    opening, rest = "WITH ", "\n" + body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.strip().startswith(start):
            opening, rest = start, ",\n" + body.strip()[len(start) :]
            break
    return f"{opening}{head}{rest}"
