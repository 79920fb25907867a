"""Canonical transaction table, the two bank layouts and the store schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names and types of the canonical table, in order.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("Transaction_ID", T.StringType()),
        T.StructField("Date", T.TimestampNTZType()),
        T.StructField("Amount", T.DoubleType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Account_Number", T.StringType()),
        T.StructField("Currency", T.StringType()),
        T.StructField("Sequence_Number", T.LongType()),
        T.StructField("Balance_After", T.DoubleType()),
        T.StructField("Counterparty_Account", T.StringType()),
        T.StructField("Counterparty_Name", T.StringType()),
        T.StructField("Ultimate_Party_Name", T.StringType()),
        T.StructField("Initiating_Party_Name", T.StringType()),
        T.StructField("Transaction_Reference", T.StringType()),
        T.StructField("Authorization_ID", T.StringType()),
        T.StructField("Creditor_ID", T.StringType()),
        T.StructField("Payment_Reference", T.StringType()),
        T.StructField("Source_File", T.StringType()),
    ]
)
TRANSACTION_COLUMNS = TRANSACTION_SCHEMA.fieldNames()

# The file a row came from; it says nothing about what the row is.
ORIGIN_COLUMN = "Source_File"

# The full hash of a transaction, 32 hex digits: the key to join by, as the short ID can have several owners.
KEY_COLUMN = "Transaction_Key"

# Names of the label store's columns, in order.
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("Transaction_ID", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Subcategory", T.StringType()),
        T.StructField("Date_Categorized", T.StringType()),
        T.StructField("Source", T.StringType()),
    ]
)

KEY_FIELD = T.StructField(KEY_COLUMN, T.StringType())
KEYED_TRANSACTION_SCHEMA = T.StructType([*TRANSACTION_SCHEMA.fields, KEY_FIELD])
KEYED_LABEL_SCHEMA = T.StructType([*LABEL_SCHEMA.fields, KEY_FIELD])

# The six columns that make up a transaction's identity, in hashing order.
IDENTITY_COLUMNS = ["Date", "Amount", "Description", "Counterparty_Name", "Account_Number", "Sequence_Number"]

# Columns a rule may name. A field that the table lacks never matches.
RULE_FIELDS = [
    "Date",
    "Amount",
    "Description",
    "Counterparty_Name",
    "Account_Number",
    "Transaction_Type",
    "Reference",
    "Balance_After",
    "Currency",
]


@dataclass(frozen=True)
class Layout:
    """How one bank writes its exports."""

    name: str
    columns: dict[str, str]
    date_formats: tuple[str, ...]
    required: tuple[str, ...]

    def accepts(self, header: list[str]) -> bool:
        return all(column in header for column in self.required)


# The header names of the two bank layouts.
LAYOUT_A = Layout(
    name="A",
    columns={
        "IBAN/BBAN": "Account_Number",
        "Munt": "Currency",
        "Volgnr": "Sequence_Number",
        "Datum": "Date",
        "Bedrag": "Amount",
        "Saldo na trn": "Balance_After",
        "Tegenrekening IBAN/BBAN": "Counterparty_Account",
        "Naam tegenpartij": "Counterparty_Name",
        "Naam uiteindelijke partij": "Ultimate_Party_Name",
        "Naam initiërende partij": "Initiating_Party_Name",
        "Transactiereferentie": "Transaction_Reference",
        "Machtigingskenmerk": "Authorization_ID",
        "Incassant ID": "Creditor_ID",
        "Betalingskenmerk": "Payment_Reference",
        "Omschrijving-1": "Description_1",
        "Omschrijving-2": "Description_2",
        "Omschrijving-3": "Description_3",
    },
    date_formats=("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd"),
    required=("Datum", "Bedrag"),
)
LAYOUT_B = Layout(
    name="B",
    columns={
        "Rekeningnummer": "Account_Number",
        "Transactiedatum": "Date",
        "Transactiebedrag": "Amount",
        "Omschrijving": "Description_1",
    },
    date_formats=("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"),
    required=("Transactiedatum", "Transactiebedrag"),
)
LAYOUTS = (LAYOUT_A, LAYOUT_B)
