"""Themes of open public policy that a text may touch, with the public pages to verify them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Theme:
    name: str
    label: str
    pattern: str
    refs: tuple[tuple[str, str], ...]
    named: str = ""


_TREATY = ("CUSMA full text (table of contents)", "https://www.international.gc.ca/trade-commerce/trade-agreements-accords-commerciaux/agr-acc/cusma-aceum/text-texte/toc-tdm.aspx?lang=eng")
_SIMA = ("SIMA / trade remedies (CBSA)", "https://www.cbsa-asfc.gc.ca/sima-lmsi/menu-eng.html")
_ICA = ("Investment Canada Act (consolidated)", "https://laws-lois.justice.gc.ca/eng/acts/I-21.8/")
_LAWS = "https://laws-lois.justice.gc.ca/eng/"

# Themes in order, patterns and addresses.
THEMES = (
    Theme("trade_agri_forestry", "Agri/forestry trade & remedy processes", "(?i)菜籽|油菜籽|canola|软木|softwood|木材出口", (_TREATY, _SIMA)),
    Theme("critical_minerals", "Critical minerals & supply chains", r"(?i)关键矿产|稀土|锂矿|镍矿|critical\s+minerals", (("Canada’s Critical Minerals Strategy", "https://www.canada.ca/en/campaign/critical-minerals-in-canada/canada-critical-minerals-strategy.html"), _ICA)),
    Theme("arctic", "Arctic & Northern policy", "(?i)北极|Arctic|极地航道", (("Canada’s Arctic foreign policy", "https://www.international.gc.ca/world-monde/issues_development-enjeux_developpement/priorities-priorites/arctic-policy-politique-arctique.aspx?lang=eng"),)),
    Theme("investment_screening", "Investment Canada Act screening (public)", r"(?i)投资审查|外资安全|并购|Investment\s+Canada", (_ICA, ("Investment Review (ISED overview)", "https://ised-isde.canada.ca/site/investment-canada-act/en")), r"(?i)Investment\s+Canada\s+Act|加拿大投资法"),
    Theme("foreign_influence_transparency", "Foreign influence transparency (public statute themes)", r"(?i)外国干涉|外国影响|代理人|foreign\s+influence|foreign\s+interference", (("Protecting democracy (public overview)", "https://www.canada.ca/en/democratic-institutions/services/protecting-democracy.html"), ("Justice Laws Website (search / consolidated acts)", _LAWS)), r"(?i)Foreign\s+Influence\s+Transparency|外国影响透明"),
    Theme("sanctions_sema", "Sanctions / SEMA public listing themes", r"(?i)制裁|制裁清单|SEMA|special\s+economic\s+measures", (("Special Economic Measures Act (consolidated)", "https://laws-lois.justice.gc.ca/eng/acts/S-14.5/"), ("Canadian sanctions (GAC)", "https://www.international.gc.ca/world-monde/international_relations-relations_internationales/sanctions/index.aspx?lang=eng")), r"(?i)SEMA|Special\s+Economic\s+Measures"),
    Theme("ev_tariffs_trade", "EV / tariff & industrial policy", "电动车|新能源车|关税|反补贴|反倾销", (("Department of Finance Canada", "https://www.canada.ca/en/department-finance.html"), _SIMA)),
    Theme("bilateral_china", "Canada–China bilateral public framing", "中加|加中|加方|加拿大", (("Canada–China relations (country page)", "https://www.international.gc.ca/country-pays/china-chine/index.aspx?lang=eng"), ("Justice Laws Website", _LAWS))),
)
