"""Small dimension tables as constants: clause headings, required clauses, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Headings by clause type, in order.
CLAUSE_HEADERS = {
    "payment_terms": ("payment terms", "payment schedule", "invoicing", "billing terms", "terms of payment", "payment conditions", "fees and payment", "payment", "payments"),
    "payment_amount": ("fees", "compensation", "contract price", "contract value", "remuneration", "consideration", "pricing", "total fee"),
    "termination_for_cause": ("termination for cause", "termination for breach", "termination for default", "termination with cause", "termination", "termination clause", "default and termination"),
    "termination_for_convenience": ("termination for convenience", "termination without cause", "termination at will", "convenience termination", "termination for convenience clause"),
    "notice_period": ("notice", "notice period", "notices", "notification", "notice clause"),
    "liability_cap": ("limitation of liability", "liability cap", "liability limit", "cap on liability", "limitation on damages", "limitation of liability"),
    "indemnification": ("indemnification", "indemnity", "hold harmless", "indemnify", "indemnification clause"),
    "ip_assignment": ("intellectual property assignment", "ip assignment", "work for hire", "assignment of intellectual property", "ownership of work", "intellectual property"),
    "ip_license": ("intellectual property license", "license grant", "ip license", "licence grant", "software license", "license"),
    "non_compete": ("non-compete", "non compete", "noncompete", "covenant not to compete", "non-competition"),
    "non_solicitation": ("non-solicitation", "non solicitation", "nonsolicitation", "covenant not to solicit"),
    "confidentiality": ("confidentiality", "confidential information", "non-disclosure", "nondisclosure", "secrecy obligations", "confidentiality clause"),
    "confidentiality_period": ("confidentiality period", "duration of confidentiality", "term of confidentiality obligation"),
    "warranty": ("warranty", "warranties", "representations and warranties", "disclaimer of warranties", "warranty clause"),
    "force_majeure": ("force majeure", "acts of god", "unforeseeable circumstances", "impossibility of performance", "force majeure clause"),
    "dispute_resolution": ("dispute resolution", "arbitration", "governing law and disputes", "jurisdiction and disputes", "mediation", "disputes"),
    "assignment": ("assignment", "transfer of rights", "assignment of agreement", "assignment and delegation", "assignment clause"),
    "entire_agreement": ("entire agreement", "merger clause", "integration clause", "complete agreement", "supersedes all prior", "entire agreement clause"),
}
# Required clauses of a contract, with severity and category.
CONTRACT_REQUIRED = (
    ("payment_terms", "warning", "Financial"), ("payment_amount", "warning", "Financial"), ("termination_for_cause", "warning", "Legal"),
    ("termination_for_convenience", "critical", "Legal"), ("liability_cap", "critical", "Financial"), ("indemnification", "critical", "Legal"),
    ("confidentiality", "warning", "Compliance"), ("warranty", "warning", "Legal"), ("force_majeure", "warning", "Legal"),
    ("assignment", "warning", "Legal"), ("entire_agreement", "warning", "Legal"), ("dispute_resolution", "warning", "Legal"),
)
# What the lack of a required clause means, by type.
MISSING_TEXTS = {
    "payment_terms": "No payment terms clause was found. Payment obligations are undefined.",
    "payment_amount": "No contract value or fee amount is specified.",
    "termination_for_cause": "No termination-for-cause clause. A party cannot exit the contract if the other materially breaches.",
    "termination_for_convenience": "No termination-for-convenience clause. Neither party can exit the agreement without cause, locking both into a long-term commitment.",
    "liability_cap": "No liability cap clause. Either party faces unlimited financial exposure under this agreement.",
    "indemnification": "No indemnification clause. The client is unprotected against third-party claims (e.g., IP infringement, data breaches).",
    "confidentiality": "No confidentiality clause. Sensitive information exchanged under this contract is unprotected.",
    "warranty": "No warranty clause. The vendor is not contractually obligated to ensure deliverables meet quality standards or are defect-free.",
    "force_majeure": "No force majeure clause. Neither party is excused from performance due to unforeseen events, which could lead to breach claims during extraordinary circumstances.",
    "assignment": "No assignment clause. Either party may assign the contract without consent, potentially transferring obligations to an undesirable party.",
    "entire_agreement": "No entire agreement clause. Prior oral or written agreements may still be enforceable, creating ambiguity.",
    "dispute_resolution": "No dispute resolution clause. There is no agreed mechanism for resolving conflicts.",
    "confidentiality_definition": "No definition of Confidential Information found. The scope of protection is undefined.",
    "confidentiality_period": "No confidentiality period stated. The obligation may extend indefinitely or not at all.",
    "exclusions": "No exclusion carve-outs found. Standard public-domain and independently-developed information is not explicitly excluded.",
    "remedies": "No remedies clause. The injured party's recourse on breach is not defined.",
    "return_or_destruction": "No return-or-destroy obligation. Confidential materials may be retained indefinitely.",
}
# Headings of clauses that only agreements of secrecy have; they come after those of contracts.
NDA_HEADERS = {
    "confidentiality_definition": ("definition of confidential information", "confidential information means", "definition", "what is confidential"),
    "permitted_disclosures": ("permitted disclosures", "permitted disclosure", "exceptions to disclosure", "disclosure to representatives"),
    "permitted_use": ("permitted use", "use of information", "authorized use", "purpose"),
    "exclusions": ("exclusions", "excluded information", "exceptions", "carve-outs", "information not covered"),
    "return_or_destruction": ("return of information", "destruction of information", "return or destroy", "return or destruction"),
    "remedies": ("remedies", "equitable relief", "injunctive relief", "damages", "specific performance"),
    "term": ("term", "duration", "effectiveness", "term of agreement"),
}
NDA_SHARED = ("non_compete", "non_solicitation", "dispute_resolution", "assignment", "notice_period", "confidentiality", "confidentiality_period")
NDA_REQUIRED = (
    ("confidentiality_definition", "critical", "Legal"), ("confidentiality_period", "warning", "Legal"), ("exclusions", "informational", "Legal"),
    ("remedies", "warning", "Legal"), ("return_or_destruction", "informational", "Compliance"),
)
# Roles by words near a name; the first role in order wins.
ROLE_WORDS = {
    "Client": ("client", "customer", "purchaser", "buyer"), "Vendor": ("vendor", "supplier", "provider", "seller"),
    "Service Provider": ("service provider", "contractor", "consultant", "developer"), "Disclosing Party": ("disclosing party", "discloser"),
    "Receiving Party": ("receiving party", "recipient"), "Licensor": ("licensor", "licens"), "Licensee": ("licensee",), "Employer": ("employer", "company"),
    "Employee": ("employee", "worker"), "Buyer": ("buyer", "purchaser"), "Seller": ("seller",),
}
# Labels of dates by the first word before "date".
DATE_LABELS = {
    "effective": "Effective Date", "execution": "Execution Date", "expiry": "Expiration Date", "expiration": "Expiration Date", "termination": "Termination Date",
    "commencement": "Commencement Date", "due": "Due Date", "renewal": "Renewal Date", "reporting": "Reporting Period", "notice": "Notice Period",
}
TYPE_LABELS = {
    "contract": "service/commercial contract", "nda": "non-disclosure agreement", "invoice": "invoice", "rfp": "request for proposal",
    "financial_statement": "financial statement", "other": "document",
}
# Sentences that stand for the types.
PROTOTYPES = {
    "contract": (
        "This Services Agreement governs the terms under which the vendor will provide services to the client.",
        "The parties agree that payment shall be due within 30 days of invoice date.",
        "Either party may terminate this agreement upon 60 days written notice.",
        "The liability of each party shall not exceed the total fees paid in the preceding 12 months.",
        "This agreement constitutes the entire understanding between the parties regarding the subject matter hereof.",
        "The contractor shall deliver the software system by the agreed milestone dates.",
    ),
    "nda": (
        "The receiving party agrees to keep all disclosed information strictly confidential.",
        "Confidential Information means any non-public information disclosed by the Disclosing Party.",
        "This Non-Disclosure Agreement shall remain in effect for a period of two years.",
        "The parties agree not to disclose proprietary business information to third parties.",
        "Information that becomes publicly available through no fault of the Receiving Party is excluded.",
        "Upon termination, the receiving party shall destroy or return all confidential materials.",
    ),
    "invoice": (
        "Invoice Number: INV-2024-0042. Due Date: 15 March 2024.",
        "Please remit payment by bank transfer to the account details below.",
        "Line Item: Software development services. Quantity: 40 hours. Unit Price: $150.",
        "Subtotal: $6,000.00. VAT (20%): $1,200.00. Total Due: $7,200.00.",
        "This invoice is payable within 30 days of the invoice date.",
        "Vendor: Acme Corp. Bill To: GlobalTech Ltd. Purchase Order: PO-8821.",
    ),
    "rfp": (
        "Proposals must be submitted by 5pm on 30 April 2024 via the online procurement portal.",
        "This Request for Proposal invites qualified vendors to submit bids for IT infrastructure services.",
        "Evaluation criteria: Technical capability 40%, Price 30%, Experience 20%, References 10%.",
        "The successful bidder will be required to sign an NDA prior to contract award.",
        "Mandatory requirements: ISO 27001 certification and minimum five years of relevant experience.",
        "Questions regarding this RFP must be submitted in writing by 15 March 2024.",
    ),
    "financial_statement": (
        "Total Revenue for the year ended 31 December 2023 was $42.5 million.",
        "Net income attributable to shareholders increased by 12% year-over-year.",
        "The balance sheet as at 30 June 2024 shows total assets of £185 million.",
        "Operating cash flow for Q3 2024 was $3.2 million, up from $2.8 million in Q3 2023.",
        "Earnings per share (basic): $1.47. Diluted EPS: $1.42.",
        "The audited financial statements have been prepared in accordance with IFRS.",
    ),
    "other": (
        "This document does not fall into any standard commercial or legal category.",
        "General correspondence, memoranda, or miscellaneous business documents.",
        "Internal policy document or procedural guideline.",
        "Technical specification or product description document.",
    ),
}
# Points by severity, least score by type of document.
POINTS = {"critical": 15, "warning": 5, "informational": 1}
BASE_SCORES = {"contract": 15, "nda": 10, "invoice": 5, "financial_statement": 10, "rfp": 5}
CATEGORIES = ("Legal", "Financial", "Compliance", "Operational")
# Stages in order.
STAGES = ("ingestion", "classification", "extraction", "anomaly", "risk", "cross_document")


def clause_headers(nda: bool = False) -> list[tuple[str, str]]:
    """(clause type, heading) in order: the first that fits counts."""
    headers = CLAUSE_HEADERS | NDA_HEADERS if nda else CLAUSE_HEADERS
    return [(kind, name) for kind, names in headers.items() for name in names]


def clause_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLAUSE_HEADERS)), "type_ord int, clause_type string")


def header_values() -> str:
    """The headings as a SQL VALUES list."""
    return ", ".join(f"({t}, '{c}', {v}, '{name}')" for t, (c, names) in enumerate(CLAUSE_HEADERS.items()) for v, name in enumerate(names))
