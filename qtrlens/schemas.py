"""Schemas of the nine tables and of the JSON payloads they are flattened from.

Tables carry no surrogate id: no query reads it, the natural key is used instead.
Money is decimal(20,2), counts bigint, year smallint, quarter int.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


_STATE_TIME = [_f("state", T.StringType()), _f("year", T.ShortType()), _f("quarter", T.IntegerType())]
_PLACE_TIME = [_f("state", T.StringType()), _f("district", T.StringType()),
               _f("year", T.ShortType()), _f("quarter", T.IntegerType())]
_TOP_TIME = [_f("state", T.StringType()), _f("district", T.StringType()), _f("pincode", T.StringType()),
             _f("year", T.ShortType()), _f("quarter", T.IntegerType())]

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "aggregated_transaction": T.StructType(_STATE_TIME + [
        _f("transaction_type", T.StringType()), _f("transaction_count", T.LongType()),
        _f("transaction_amount", MONEY)]),
    "aggregated_user": T.StructType(_STATE_TIME + [
        _f("brand", T.StringType()), _f("user_count", T.LongType()),
        _f("registered_users", T.LongType()), _f("app_opens", T.LongType())]),
    "aggregated_insurance": T.StructType(_STATE_TIME + [
        _f("insurance_count", T.LongType()), _f("insurance_amount", MONEY)]),
    "map_transaction": T.StructType(_PLACE_TIME + [
        _f("transaction_count", T.LongType()), _f("transaction_amount", MONEY)]),
    "map_user": T.StructType(_PLACE_TIME + [
        _f("registered_users", T.LongType()), _f("app_opens", T.LongType())]),
    "map_insurance": T.StructType(_PLACE_TIME + [
        _f("insurance_count", T.LongType()), _f("insurance_amount", MONEY)]),
    "top_transaction": T.StructType(_TOP_TIME + [
        _f("transaction_count", T.LongType()), _f("transaction_amount", MONEY)]),
    "top_user": T.StructType(_TOP_TIME + [_f("registered_users", T.LongType())]),
    "top_insurance": T.StructType(_TOP_TIME + [
        _f("insurance_count", T.LongType()), _f("insurance_amount", MONEY)]),
}

TABLES = list(TABLE_SCHEMAS)

# Load order of the ETL: aggregated tier, map tier, top tier.
TIERS = {
    "aggregated": ["aggregated_transaction", "aggregated_user", "aggregated_insurance"],
    "map": ["map_transaction", "map_user", "map_insurance"],
    "top": ["top_transaction", "top_user", "top_insurance"],
}

# ---- JSON payloads (one file per state / year / quarter) -------------------------

# Counts may be written as 1 or 1.0: they are read as decimals and cast.
COUNT = T.DecimalType(20, 2)

_COUNT_AMOUNT = T.StructType([_f("count", COUNT), _f("amount", MONEY)])

PAYLOAD_TRANSACTION = T.StructType([_f("data", T.StructType([
    _f("transactionData", T.ArrayType(T.StructType([
        _f("name", T.StringType()),
        _f("paymentInstruments", T.ArrayType(_COUNT_AMOUNT))])))]))])

PAYLOAD_USER = T.StructType([_f("data", T.StructType([
    _f("aggregated", T.StructType([_f("registeredUsers", COUNT), _f("appOpens", COUNT)])),
    _f("usersByDevice", T.ArrayType(T.StructType([
        _f("brand", T.StringType()), _f("count", COUNT)])))]))])

PAYLOAD_HOVER_LIST = T.StructType([_f("data", T.StructType([
    _f("hoverDataList", T.ArrayType(T.StructType([
        _f("name", T.StringType()), _f("metric", T.ArrayType(_COUNT_AMOUNT))])))]))])

PAYLOAD_HOVER_MAP = T.StructType([_f("data", T.StructType([
    _f("hoverData", T.MapType(T.StringType(), T.StructType([
        _f("registeredUsers", COUNT), _f("appOpens", COUNT)])))]))])

_ENTITY_METRIC = T.StructType([_f("entityName", T.StringType()), _f("metric", _COUNT_AMOUNT)])
PAYLOAD_TOP_METRIC = T.StructType([_f("data", T.StructType([
    _f("districts", T.ArrayType(_ENTITY_METRIC)), _f("pincodes", T.ArrayType(_ENTITY_METRIC))]))])

_NAME_USERS = T.StructType([_f("name", T.StringType()), _f("registeredUsers", COUNT)])
PAYLOAD_TOP_USER = T.StructType([_f("data", T.StructType([
    _f("districts", T.ArrayType(_NAME_USERS)), _f("pincodes", T.ArrayType(_NAME_USERS))]))])
