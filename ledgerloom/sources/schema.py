"""The canonical tables: their columns, types, and the headers under which exports know them."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: (column, required, type, aliases); the first registration of an alias counts.
BOOKS = (
    ("transaction_id", False, "string", ["transaction_id", "txn_id", "id", "voucher_no", "voucher_number", "vouch_no", "vouch_number", "voucher", "entry_id", "reference", "ref_no"]),
    ("customer_name", True, "string", ["customer_name", "customer", "party_name", "customer_party_name", "party", "name", "particulars", "client_name"]),
    ("customer_code", False, "string", ["customer_code", "party_code", "code", "ledger_code", "customer_id"]),
    ("party_pan", False, "string", ["party_pan", "pan", "customer_pan", "pan_no", "pan_number"]),
    ("party_gstin", False, "string", ["party_gstin", "gstin", "gst_no", "gst_number", "customer_gstin"]),
    ("document_number", False, "string", ["document_number", "doc_no", "document_no", "invoice_no", "invoice_number", "bill_no", "invoice"]),
    ("document_date", True, "date", ["document_date", "doc_date", "voucher_date", "posting_date", "invoice_date", "date", "bill_date", "transaction_date", "entry_date"]),
    ("taxable_value", False, "money", ["taxable_value", "taxable_amount", "base_amount", "net_amount", "invoice_value", "amount"]),
    ("gst_value", False, "money", ["gst_value", "gst_amount", "gst"]),
    ("tds_base_amount", False, "money", ["tds_base_amount", "amount_paid_credited", "amount_paid_or_credited", "tds_calculation_base"]),
    ("advance", False, "string", ["advance", "is_advance", "advance_flag"]),
    ("voucher_type", False, "string", ["voucher_type", "vouch_type", "entry_type"]),
    ("source_period", False, "string", ["month", "source_period", "period", "reporting_period"]),
    ("tds_expected", False, "money", ["tds_expected", "tds", "tds_amount", "tds_receivable", "tds_receivable_from_others", "tds_deducted", "expected_tds"]),
    ("section", False, "string", ["section", "tds_section", "section_code"]),
    ("financial_year", False, "string", ["financial_year", "fy"]),
    ("source_ledger", False, "string", ["ledger", "ledger_name", "ledger_account", "account_name", "account", "account_description"]),
    ("debit_amount", False, "money", ["debit", "debit_amount", "dr"]),
    ("credit_amount", False, "money", ["credit", "credit_amount", "cr"]),
    ("narration", False, "string", ["narration", "description", "remarks", "memo"]),
)
STATEMENT = (
    ("tan", True, "string", ["tan", "tan_of_deductor", "deductor_tan", "tan_no"]),
    ("deductor_name", True, "string", ["deductor_name", "name_of_deductor", "deductor", "name", "party_name"]),
    ("transaction_date", True, "date", ["transaction_date", "date_of_transaction", "date", "date_of_payment_credit", "date_of_payment"]),
    ("tax_deducted", True, "money", ["tax_deducted", "tds_deducted", "tds", "tax_deducted_amount", "amount_of_tds", "amount_of_tax_deducted", "total_tds_deducted"]),
    ("tds_deposited", False, "money", ["tds_deposited", "tax_deposited", "tds_deposited_amount", "amount_deposited", "deposited"]),
    ("status", False, "string", ["status", "status_of_booking", "booking_status"]),
    ("section", False, "string", ["section", "section_code"]),
    ("amount_paid", False, "money", ["amount_paid", "amount_paid_credited", "total_amount_paid_credited", "amount_credited_paid", "amount"]),
    ("financial_year", False, "string", ["financial_year", "fy"]),
    ("statement_id", False, "string", ["26as_record_id", "record_id", "statement_record_id", "transaction_id"]),
    ("deductor_pan", False, "string", ["deductor_pan", "pan_of_deductor", "deductor_pan_no"]),
)
MASTER = (
    ("customer_code", True, "string", ["customer_code", "code", "party_code", "customer_id"]),
    ("customer_name", True, "string", ["customer_name", "name", "party_name", "customer"]),
    ("pan", False, "string", ["pan", "customer_pan", "party_pan"]),
    ("gstin", False, "string", ["gstin", "gst_no", "customer_gstin"]),
    ("tan", False, "list", ["tan", "tans", "deductor_tan", "tan_list"]),
    ("aliases", False, "list", ["aliases", "alias", "alternate_names", "alternate_name", "aka"]),
)
DEPOSITS = (
    ("deposit_transaction_id", False, "string", ["deposit_transaction_id", "transaction_id", "payment_reference", "reference", "source_reference"]),
    ("challan_number", False, "string", ["challan_number", "challan_no"]),
    ("deposit_date", False, "date", ["deposit_date", "date_of_deposit"]),
    ("tds_amount", False, "money", ["tds_amount", "tds_deposited", "tax_deposited"]),
    ("interest_amount", False, "money", ["interest_amount", "interest"]),
    ("fee_amount", False, "money", ["fee_amount", "fee"]),
    ("total_amount", False, "money", ["total_amount", "total"]),
    ("tan", False, "string", ["tan"]),
    ("financial_year", False, "string", ["financial_year", "fy"]),
)
RECEIVABLE = (
    ("tds_transaction_id", False, "string", ["tds_transaction_id", "transaction_id", "txn_id", "voucher_no", "voucher_number", "reference", "ref_no", "invoice_no"]),
    ("party_name", True, "string", ["party_name", "party", "customer_name", "customer", "payee", "payer", "deductor_name", "deductor", "ledger", "particulars"]),
    ("party_pan", False, "string", ["party_pan", "pan", "customer_pan", "payee_pan", "pan_no"]),
    ("party_gstin", False, "string", ["party_gstin", "gstin", "gst_no", "gst_number", "customer_gstin"]),
    ("tan", False, "string", ["tan", "deductor_tan", "tan_of_deductor", "tan_no"]),
    ("transaction_date", False, "date", ["transaction_date", "date", "voucher_date", "document_date", "invoice_date", "entry_date"]),
    ("reference", False, "string", ["reference", "ref_no", "invoice_no", "invoice_number", "document_number", "voucher_no"]),
    ("tds_expected", True, "money", ["tds_expected", "tds_receivable", "tds_amount", "tds", "tds_deducted", "tax_receivable", "tds_receivable_from_others"]),
    ("section", False, "string", ["section", "tds_section", "section_code"]),
    ("tds_base_amount", False, "money", ["tds_base_amount", "amount_paid_credited", "amount_paid_or_credited", "tds_calculation_base"]),
    ("financial_year", False, "string", ["financial_year", "fy"]),
)
SALES = (
    ("sales_transaction_id", False, "string", ["sales_transaction_id", "transaction_id", "txn_id", "id", "reference", "ref_no", "sno", "serial_no", "serial_number"]),
    ("customer_name", True, "string", ["customer_name", "customer", "party_name", "customer_party_name", "party", "buyer_name", "buyer", "client_name", "client", "recipient", "recipient_name", "recipients_name", "purchaser_name"]),
    ("customer_pan", False, "string", ["customer_pan", "party_pan", "pan", "pan_no"]),
    ("customer_gstin", False, "string", ["customer_gstin", "party_gstin", "gstin", "gst_no", "gst_number"]),
    ("invoice_number", False, "string", ["invoice_number", "invoice_no", "invoice", "bill_no", "document_number", "doc_no"]),
    ("invoice_date", True, "date", ["invoice_date", "date", "document_date", "doc_date", "transaction_date", "bill_date"]),
    ("sales_amount", False, "money", ["sales_amount", "sales_value", "gross_sales", "taxable_sales_amount", "amount_before_tax"]),
    ("invoice_value", False, "money", ["invoice_value", "invoice_amount", "gross_invoice_value"]),
    ("taxable_amount", False, "money", ["taxable_amount", "taxable_value", "taxable_sales", "assessable_value"]),
    ("period", False, "string", ["period", "reporting_period", "return_period", "tax_period"]),
    ("state", False, "string", ["state", "place_of_supply"]),
    ("reference", False, "string", ["reference", "ref_no", "purchase_order", "po_no", "customer_reference"]),
    ("financial_year", False, "string", ["financial_year", "fy"]),
)
PAYMENTS = (
    ("transaction_id", False, "string", ["transaction_id", "txn_id", "voucher_no", "voucher_number", "reference", "entry_id"]),
    ("deductee_name", False, "string", ["vendor_name", "vendor", "supplier_name", "supplier", "party_name", "deductee_name", "deductee", "customer_vendor_name"]),
    ("deductee_pan", False, "string", ["pan", "vendor_pan", "supplier_pan", "deductee_pan", "party_pan"]),
    ("vendor_code", False, "string", ["vendor_code", "supplier_code", "party_code", "vendor_id"]),
    ("invoice_number", False, "string", ["invoice_no", "invoice_number", "bill_no", "bill_number", "document_no", "document_number"]),
    ("transaction_date", False, "string", ["transaction_date", "date", "entry_date"]),
    ("credit_date", False, "string", ["credit_date", "date_of_credit", "accounting_date", "accrual_date"]),
    ("payment_date", False, "string", ["payment_date", "date_of_payment", "paid_date"]),
    ("amount", False, "string", ["amount", "invoice_amount", "gross_amount", "payment_amount", "transaction_amount", "bill_amount"]),
    ("payment_nature", False, "string", ["payment_nature", "nature_of_payment", "expense_type", "transaction_type"]),
    ("description", False, "string", ["description", "narration", "particulars"]),
    ("section_input", False, "string", ["section", "tds_section", "section_code"]),
    ("tds_deducted", False, "string", ["tds_deducted", "tds", "tax_deducted", "tds_amount"]),
    ("financial_year", False, "string", ["fy", "financial_year", "fiscal_year", "tax_year"]),
)
KINDS = {
    "books": BOOKS, "form26as": STATEMENT, "customer_master": MASTER, "tds_receivable": RECEIVABLE, "sales_registry": SALES,
    "payment_ledger": PAYMENTS, "tds_deposit_evidence": DEPOSITS,
}
TYPES = {"string": T.StringType(), "date": T.DateType(), "money": T.DecimalType(18, 2), "list": T.ArrayType(T.StringType())}


def aliases(kind: str) -> dict[str, tuple[str, bool]]:
    """header key -> (column, required)."""
    out: dict[str, tuple[str, bool]] = {}
    for column, required, _, names in KINDS[kind]:
        for name in names:
            out.setdefault(name, (column, required))
    return out


def struct(kind: str) -> T.StructType:
    fields = [T.StructField(c, TYPES[t]) for c, _, t, _ in KINDS[kind]]
    return T.StructType([T.StructField("row_no", T.LongType()), *fields])
