"""Declared schemas and column translations of the source files."""

from __future__ import annotations

from pyspark.sql import types as T

# Price sheet headings and the names used from then on.
PRICE_NAMES = {
    "TARİH": "date",
    "FON KODU": "code",
    "FON ADI": "name",
    "FİYAT": "price",
    "TEDAVÜLDEKİ PAY SAYISI": "shares",
    "KİŞİ SAYISI": "people",
    "FON TOPLAM DEĞER": "total_value",
}

# Allocation sheet headings and the names used from then on.
ALLOCATION_NAMES = {
    "Banka Bonosu (%)": "p_Bank_Bills",
    "Diğer (%)": "p_Other",
    "Döviz Ödemeli Bono (%)": "p_FX_Payable_Bills",
    "Devlet Tahvili (%)": "p_Government_Bond",
    "Dövize Ödemeli Tahvil (%)": "p_Foreign_Currency_Bills",
    "Eurobonds (%)": "p_Eurobonds",
    "Finansman Bonosu (%)": "p_Commercial_Paper",
    "Fon Katılma Belgesi (%)": "p_Fund_Participation_Certificate",
    "Gayrı Menkul Sertifikası (%)": "p_Real_Estate_Certificate",
    "Hazine Bonosu (%)": "p_Treasury_Bill",
    "Hisse Senedi (%)": "p_Stock",
    "Kamu Dış Borçlanma Araçları (%)": "p_Government_Bonds_and_Bills_FX",
    "Katılım Hesabı (%)": "p_Participation_Account",
    "Kamu Kira Sertifikaları (%)": "p_Government_Lease_Certificates",
    "Kıymetli Madenler (%)": "p_Precious_Metals",
    "Özel Sektör Kira Sertifikaları (%)": "p_Private_Sector_Lease_Certificates",
    "Özel Sektör Tahvili (%)": "p_Private_Sector_Bond",
    "Repo (%)": "p_Repo",
    "Türev Araçları (%)": "p_Derivatives",
    "TPP (%)": "p_TMM",
    "Ters-Repo (%)": "p_Reverse_Repo",
    "Varlığa Dayalı Menkul Kıymetler (%)": "p_Asset_Backed_Securities",
    "Vadeli Mevduat (%)": "p_Term_Deposit",
    "Yabancı Borçlanma Aracı (%)": "p_Foreign_Debt_Instruments",
    "Yabancı Hisse Senedi (%)": "p_Foreign_Equity",
    "Yabancı Menkul Kıymet (%)": "p_Foreign_Securities",
}
ALLOCATION_KEYS = {"Tarih": "date", "Fon Kodu": "code", "Fon Adı": "name"}

ENTITY = ("code", "fund_type", "category", "company_name")
FLAGS = ("OKS", "participation", "contribution")
# The six benchmark series.
BENCHMARKS = ("b_tufe", "b_usd", "b_gold", "b_xu100", "b_property_index", "b_deposit_rate")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _NUMBER, _DATE, _FLAG = T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType()

PRICE_SHEET = _struct(**{
    heading: {"date": _DATE, "code": _TEXT, "name": _TEXT}.get(name, _NUMBER)
    for heading, name in PRICE_NAMES.items()
})
ALLOCATION_SHEET = _struct(**{"Tarih": _DATE, "Fon Kodu": _TEXT, "Fon Adı": _TEXT}
                           | {heading: _NUMBER for heading in ALLOCATION_NAMES})
DAILY_PANEL = _struct(
    date=_DATE, code=_TEXT, fund_type=_TEXT, category=_TEXT, name=_TEXT,
    **{name: _NUMBER for name in PRICE_NAMES.values() if name not in ("date", "code", "name")},
    **{name: _NUMBER for name in ALLOCATION_NAMES.values()})
CATEGORIES = _struct(code=_TEXT, category=_TEXT)
COMPANIES = _struct(company_code=_TEXT, company_name=_TEXT, company_type=_TEXT)
BENCHMARK_WIDE = _struct(date=_DATE, **{name: _NUMBER for name in BENCHMARKS})
CROSSTAB = _struct(label=_TEXT, blank_1=_TEXT, blank_2=_TEXT, year=_TEXT, month=_TEXT, value=_TEXT, blank_3=_TEXT)

# Fields of one station record, in document order.
STATION_FIELDS = ("ID", "STATION_NO", "STATION_NAME", "ACTIVE", "EMPTY", "FULL", "LAT", "LON", "LAST_CONNECTION")
