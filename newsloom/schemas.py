"""Schemas of the tables that sources give and sinks take."""

from __future__ import annotations

COMPANY = "symbol string, company_name string, series string, listing_date date, paid_up_value double, market_lot int, isin_number string, face_value double"
ARTICLE = "title string, description string, link string, published string, source string, relevance_score double"
CACHE = (
    "id int, company_symbol string, article_title string, article_content string, article_url string, source_name string, "
    "published_date string, relevance_score double, cached_date string, expires_date string"
)
FEED_ITEM = (
    "title string, link string, summary string, description string, content string, published string, updated string, pubDate string, "
    "author string, guid string, category array<string>"
)
ANSWER = "array<struct<title: string, url: string, date: string, summary: string>>"
LABELLED = "text string, label string"
EXPORT = "text string, source string, published_date string, url string, relevance_score double, symbol string"
