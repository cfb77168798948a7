"""Business documents rendered from the order tables, with the truth of every fact beside the text.

Ten layouts by order key, so that each way of writing dates, amounts and terms is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import dealt

#: What both engines compute alike: the truth columns of a rendered document.
TRUTH_SQL = """
select o_orderkey doc_id, cast(o_orderkey % 10 as int) variant, cast(o_orderdate as date) issue_date,
  cast(round(o_totalprice * 100) as bigint) total_minor, cast(15 + o_orderkey % 46 as int) net_days, cast(1 + o_orderkey % 24 as int) term_months,
  cast(15 * (1 + o_orderkey % 4) as int) notice_days, o_custkey cust, o_orderkey % 97 + 1 issuer
from orders
"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr(
        "o_orderkey doc_id", "cast(o_orderkey % 10 as int) variant", "cast(o_orderdate as date) issue_date", "cast(round(o_totalprice * 100) as bigint) total_minor",
        "cast(15 + o_orderkey % 46 as int) net_days", "cast(1 + o_orderkey % 24 as int) term_months", "cast(15 * (1 + o_orderkey % 4) as int) notice_days",
        "o_custkey cust", "o_orderkey % 97 + 1 issuer",
    )


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth columns and full_text; rows are dealt over tasks first, whatever the files of the orders."""
    t = dealt(truth(spark, sf_dir))
    plain = F.format_string("%d.%02d", F.expr("total_minor div 100"), F.col("total_minor") % 100)
    short = lambda d: F.date_format(d, "dd/MM/yyyy")
    long = lambda d: F.date_format(d, "d MMMM yyyy")
    issue, due = F.col("issue_date"), F.date_add("issue_date", F.col("net_days"))
    client, issuer = F.format_string("Buyer House %d Pvt Ltd", "cust"), F.format_string("Maker Works %d", "issuer")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    invoice = lambda head, total, tail: cat("TAX INVOICE\nFrom: ", issuer, ", New Town\nBill To: ", client, "\n", head, "\nGrand Total: ", total, "\n", tail)
    contract = lambda title, body: cat(title, "\n\nThis Agreement is made on ", long(issue), " between ", issuer, ' (hereinafter called the "Vendor"), and ', client, ' (hereinafter called the "Client").\n\n', body)
    end = F.date_sub(F.add_months(issue, F.col("term_months")), 1)
    hundredths = F.round(F.expr("total_minor div 100") / F.lit(100000.0) * F.lit(100.0)).cast("long")  # the double times 100 decides, as in SQL
    lakh = F.format_string("%d.%02d", F.floor(hundredths / 100).cast("long"), hundredths % 100)
    texts = [
        invoice(cat("Invoice Date: ", short(issue)), cat("₹", plain), cat("Due Date: ", short(due))),
        invoice(cat("Invoice Date: ", long(issue)), cat("Rs. ", plain), cat("Payment due by ", long(due))),
        invoice(cat("Invoice Date: ", long(issue)), cat("INR ", plain), cat("Payment terms: Net ", F.col("net_days").cast("string"), " days")),
        contract("FREELANCE SERVICES AGREEMENT", cat("1. Fees\nThe total project fee is Rs. ", plain, ".\nThis Agreement shall remain in force for a period of ", F.col("term_months").cast("string"), " months.")),
        contract("RENT AGREEMENT", cat("The Client shall pay a monthly rent of Rs. ", plain, " on or before the 5th day of each month.\nThis Agreement is valid from ", long(issue), " to ", long(end), ".")),
        contract("VENDOR AGREEMENT", cat("The total contract value is USD ", plain, ".\nEither party may terminate this Agreement by giving ", F.col("notice_days").cast("string"), " days written notice.")),
        contract("SERVICE AGREEMENT", cat("The total fee is Rs. ", plain, ".\nThis Agreement shall automatically renew for a further period of 1 year unless either party gives ", F.col("notice_days").cast("string"), " days written notice.")),
        contract("CONTRACT FOR GOODS", cat("The total consideration is Rs. ", lakh, " lakh.\nThis Agreement may be renewed by mutual consent.")),
        cat("QUOTATION\nFrom: ", issuer, "\nTo: ", client, "\nQuotation Date: ", F.date_format(issue, "yyyy-MM-dd"), "\nTotal Amount: $", plain, "\nValid till ", long(due)),
        cat("Dear Sir,\nSubject: your order\nYour order of ", F.format_string("%d", "doc_id"), " pieces has been packed. Part numbers 10.0.0.1 and 192.168.1.7 are included.\nYours faithfully,\n", issuer),
    ]
    pick = F.coalesce(*(F.when(F.col("variant") == i, text) for i, text in enumerate(texts)))  # only the row's own layout is written
    return t.withColumn("full_text", pick)


#: Kinds of document the layouts stand for, in order.
KINDS = ["invoice", "invoice", "invoice", "freelance_agreement", "rental_agreement", "contract", "service_agreement", "contract", "quotation", "business_letter"]
