"""What is read from a parsed page: sections, links, paragraphs, contacts, samples, cards, properties.

All of it is column expressions over one page row, bounded by that page, so none of it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost import vocabulary as V
from signpost.functions.text import (
    blank, casefold, clean_text, contains_any, let, or_else, remove_prefix, starts_with_any,
    strip_trailing,
)
from signpost.functions.urls import strip_fragment, url_host
from signpost.operators.pages import (
    GUIDANCE_UPDATED, SAMPLE_ROOTS, UPDATED_PREFIX, USEFUL_ROOTS, Test, first, raw_text_of, select,
    tagged, text_of, text_or_blank, with_class,
)

HEADINGS = ("h2", "h3")


def is_link(n: Column) -> Column:
    return (n["tag"] == "a") & n["href"].isNotNull()


def first_by(items: Column, key, n: int | None = None) -> Column:
    """First item per key in array order, at most ``n`` keys."""
    def places(bound: Column) -> Column:
        # Sorted by key and place, the first of each key follows another key.
        sort = F.array_sort(F.transform(bound, lambda x, i: F.struct(key(x).alias("key"), i.alias("place"))))
        return let(sort, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["key"].eqNullSafe(x["key"])),
            lambda x: x["place"])))

    def pick(bound: Column) -> Column:
        wanted = places(bound) if n is None else F.slice(places(bound), 1, n)
        return F.transform(wanted, lambda i: F.get(bound, i))
    return let(items, pick)


# -- navigator candidates -------------------------------------------------------------------


def accepted_headings(root: Column, skip: Sequence[str], tags: Sequence[str] = HEADINGS) -> Column:
    """Headings of the root that may name a service: ``struct(seq, tag, title)``."""
    def of(r: Column) -> Column:
        titled = F.transform(
            select(tagged(*tags), r),
            lambda n: F.struct(
                n["seq"].alias("seq"), n["tag"].alias("tag"),
                strip_trailing(text_of(n), ":").alias("title"),
            ),
        )
        return F.filter(
            titled,
            lambda h: ~h["title"].isin(*skip) & F.length(h["title"]).between(4, 180),
        )
    return let(root, of)


def heading_items(headings: Column, page_title: Column, source_url: Column, n: int, top: str = "h2") -> Column:
    """First heading per folded title, with the section carried forward from the last top heading.

    Every accepted top heading advances the section, repeated titles included.
    """
    def build(sections: Column) -> Column:
        def item(h: Column) -> Column:
            current = F.try_element_at(
                F.filter(sections, lambda s: s["seq"] <= h["seq"]), F.lit(-1)
            )["title"]
            return F.struct(
                F.lit("page_section").alias("record_type"),
                F.trim(h["title"]).alias("service_name"),
                F.trim(F.coalesce(current, page_title)).alias("section"),
                source_url.alias("service_url"),
            )
        return F.transform(first_by(headings, lambda h: casefold(h["title"]), n), item)
    return let(F.filter(headings, lambda h: h["tag"] == top), build)


def internal_links(root: Column, source_url: Column, skip: Sequence[str]) -> Column:
    """Links of the root to other pages of the same host: ``struct(title, url)``."""
    def of(r: Column) -> Column:
        links = F.transform(
            select(is_link, r),
            lambda n: F.struct(
                strip_trailing(text_of(n), ":").alias("title"),
                strip_fragment(n["href_abs"]).alias("url"),
            ),
        )
        return F.filter(
            links,
            lambda a: ~a["title"].isin(*skip)
            & F.length(a["title"]).between(4, 160)
            & F.startswith(a["url"], F.lit("http"))
            & (url_host(a["url"]) == url_host(source_url))
            & (a["url"] != F.rtrim(source_url, F.lit("/"))),
        )
    return let(root, of)


def link_items(links: Column, page_title: Column, n: int) -> Column:
    return F.transform(
        first_by(links, lambda a: a["url"], n),
        lambda a: F.struct(
            F.lit("internal_resource").alias("record_type"),
            F.trim(a["title"]).alias("service_name"),
            page_title.alias("section"),
            a["url"].alias("service_url"),
        ),
    )


# -- guidance -------------------------------------------------------------------------------


def _guidance_item(kind: str, seq: Column, title: Column, section: Column, category: Column,
                   linked_title: Column, linked_url: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("record_type"), seq.alias("seq"), title.alias("action_title"),
        section.alias("section"), category.alias("category"),
        linked_title.alias("linked_resource_title"), linked_url.alias("linked_resource_url"),
    )


def _resource_items(links: Column, section: Column, category: Column, exclude) -> Column:
    resolved = F.transform(
        links,
        lambda n: F.struct(
            n["seq"].alias("seq"), text_of(n).alias("title"), strip_fragment(n["href_abs"]).alias("url")
        ),
    )
    kept = F.filter(resolved, lambda a: F.startswith(a["url"], F.lit("http")) & ~exclude(a["url"]))
    return F.transform(
        first_by(kept, lambda a: a["url"]),
        lambda a: _guidance_item(
            "linked_resource", a["seq"], or_else(a["title"], a["url"]), section, category,
            or_else(a["title"], a["url"]), a["url"],
        ),
    )


def _action_items(kind: str, nodes: Column, section: Column, category: Column, skip: Sequence[str]) -> Column:
    titled = F.transform(nodes, lambda n: F.struct(n["seq"].alias("seq"), text_of(n).alias("title")))
    kept = F.filter(titled, lambda t: ~t["title"].isin(*skip))
    return F.transform(
        first_by(kept, lambda t: t["title"]),
        lambda t: _guidance_item(
            kind, t["seq"], t["title"], section, category, F.lit(""), F.lit("")
        ),
    )


def hub_sections(root: Column) -> Column:
    """Section title to its last h2 of that text, for the sections that are present."""
    def of(r: Column) -> Column:
        return F.transform(
            select(tagged("h2"), r),
            lambda h: F.struct(text_of(h).alias("section"), h["parent_seq"].alias("parent_seq")),
        )
    return let(root, of)


def _below(parent_seq: Column) -> Column:
    """Descendants of the node at ``parent_seq``; -1 is the document."""
    nodes = F.col("nodes")
    parent = F.get(nodes, F.greatest(parent_seq, F.lit(0)))
    return F.when(parent_seq < 0, nodes).otherwise(
        F.slice(nodes, parent_seq + 2, parent["end_seq"] - parent_seq)
    )


def hub_items(sections: Column, base: Column, vocabulary=V.SECTION_CATEGORIES,
              skip: Sequence[str] = V.GUIDANCE_SKIP_HEADINGS) -> Column:
    """Actions and resources of every selected section of a hub page.

    An action is an h3/h4, or bold text that starts its paragraph or list item.
    """
    wanted = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(c).alias("category")) for s, c in vocabulary])
    nodes = F.col("nodes")

    def leads_parent(n: Column) -> Column:
        parent = F.get(nodes, F.greatest(n["parent_seq"], F.lit(0)))
        return (
            n["tag"].isin("strong", "b") & (n["parent_seq"] >= 0) & parent["tag"].isin("p", "li")
            & F.startswith(text_of(parent), text_of(n))
        )

    def section_items(want: Column, headings: Column) -> Column:
        def items(inner: Column) -> Column:
            actions = F.filter(inner, lambda n: n["tag"].isin("h3", "h4") | leads_parent(n))
            links = F.filter(inner, lambda n: is_link(n) & (n["href"] != ""))
            return F.concat(
                _action_items("hub_action", actions, want["section"], want["category"], skip),
                _resource_items(links, want["section"], want["category"], lambda u: u == base),
            )
        heading = F.try_element_at(
            F.filter(headings, lambda h: h["section"] == want["section"]), F.lit(-1)
        )
        return let(heading, lambda h: F.when(h.isNotNull(), let(_below(h["parent_seq"]), items)))

    found = let(sections, lambda hs: F.transform(wanted, lambda want: section_items(want, hs)))
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def detail_items(root: Column, page_title: Column, category: Column, base: Column,
                 allowlist: Sequence[str], skip: Sequence[str] = V.GUIDANCE_SKIP_HEADINGS) -> Column:
    """Actions (h2/h3) and resources of one detail page; allowlisted pages are not resources."""
    def of(r: Column) -> Column:
        return F.concat(
            _action_items("detail_action", select(tagged(*HEADINGS), r), page_title, category, skip),
            _resource_items(
                select(is_link, r), page_title, category,
                lambda u: (u == base) | u.isin(*allowlist),
            ),
        )
    return let(root, of)


# -- useful records -------------------------------------------------------------------------


def paragraph_texts(root: Column, fragments: Sequence[str]) -> Column:
    """Meaningful paragraphs of a root: all ``p`` before all ``li``, 55 to 900 characters."""
    def sized(tag: str) -> Column:
        return select(lambda n: (n["tag"] == tag) & n["text_len"].between(55, 900), root)

    texts = F.transform(F.concat(sized("p"), sized("li")), text_of)
    return F.filter(texts, lambda t: ~contains_any(casefold(t), fragments))


def first_root_with_paragraphs(fragments: Sequence[str], priority: Sequence[Test] = USEFUL_ROOTS) -> Column:
    """``struct(root, paragraphs)`` of the first root that yields a meaningful paragraph."""
    def attempt(test: Test) -> Column:
        return let(first(test), lambda r: let(
            paragraph_texts(r, fragments),
            lambda ts: F.when(F.size(ts) > 0, F.struct(r.alias("root"), ts.alias("paragraphs"))),
        ))
    return F.coalesce(*[attempt(t) for t in priority])


def leading_paragraphs(texts: Column) -> Column:
    """The first two paragraphs that differ under case folding."""
    def pair(head: Column) -> Column:
        other = F.get(F.filter(texts, lambda t: casefold(t) != casefold(head)), F.lit(0))
        return F.when(other.isNull(), F.array(head)).otherwise(F.array(head, other))
    return let(F.get(texts, F.lit(0)), pair)


def access_methods(root: Column, keywords: Sequence[str] = V.ACCESS_KEYWORDS, n: int = 4) -> Column:
    """First ``n`` distinct ``label: url`` of links that mail, call or name an access route."""
    direct = ("mailto:", "tel:")

    def wanted(a: Column) -> Column:
        return (a["label"] != "") & (
            starts_with_any(a["href"], direct) | contains_any(casefold(a["label"]), keywords)
        )

    def of(r: Column) -> Column:
        labelled = F.transform(select(is_link, r), lambda a: F.struct(
            text_of(a).alias("label"), a["href"].alias("href"), a["href_abs"].alias("href_abs")))
        methods = F.transform(F.filter(labelled, wanted), lambda a: F.concat(
            a["label"], F.lit(": "),
            F.when(starts_with_any(a["href"], direct), a["href"]).otherwise(blank(a["href_abs"])),
        ))
        return F.slice(F.array_distinct(methods), 1, n)
    return let(root, of)


# -- parse samples --------------------------------------------------------------------------


def parse_sample(priority: Sequence[Test] = SAMPLE_ROOTS) -> Column:
    """``struct(sample_type, parsed_sample)``: paragraph, else heading, else the page text."""
    def paragraph(n: Column) -> Column:
        return n["tag"].isin("p", "li") & n["text_len"].between(60, 1200)

    def heading(n: Column) -> Column:
        return n["tag"].isin("h1", "h2", "h3") & (n["text_len"] >= 4)

    def level(kind: str, test: Test) -> Column:
        hits = [let(first(root), lambda r: first(test, r)) for root in priority]
        return let(F.coalesce(*hits), lambda n: F.when(n.isNotNull(), F.struct(
            F.lit(kind).alias("sample_type"), F.substring(text_of(n), 1, 600).alias("parsed_sample"))))

    whole = blank("text")
    return F.coalesce(
        level("paragraph_or_list", paragraph),
        level("heading", heading),
        F.struct(
            F.when(whole != "", F.lit("page_text")).otherwise(F.lit("")).alias("sample_type"),
            F.substring(whole, 1, 600).alias("parsed_sample"),
        ),
    )


def headings_found() -> Column:
    return F.size(select(tagged("h1", "h2", "h3")))


def links_found() -> Column:
    return F.size(select(is_link))


def title_tag() -> Column:
    return text_or_blank(first(tagged("title")))


# -- partner listing and detail -------------------------------------------------------------


def _count_before(rising: Column, seq: Column) -> Column:
    """How many of the rising numbers are less than ``seq``, found by halving; ``rising`` must be a lambda variable."""
    bits = F.ceil(F.log2(F.size(rising) + 1)).cast("int")
    powers = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(
        (n + p <= F.size(rising)) & (F.get(rising, n + p - 1) < seq), n + p).otherwise(n))


def _greatest_so_far(numbers: Column) -> Column:
    """The greatest of each number and those before it, by doubling the reach; ``numbers`` must be a lambda variable."""
    bits = F.ceil(F.log2(F.size(numbers) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), bits), numbers, lambda best, k: F.transform(
        best, lambda x, i: F.greatest(x, F.get(best, i - F.pow(F.lit(2), k).cast("int")))))


def nodes_under(test: Test, above: Test) -> Column:
    """Nodes that pass ``test`` and lie below one that passes ``above``, in document order.

    A node lies below one of them if the furthest end of those that begin before it is not before
    it, so each node is placed once among them and no pair is formed.
    """
    def under(tops: Column) -> Column:
        return let(F.transform(tops, lambda t: t["seq"]), lambda begins: let(
            let(F.transform(tops, lambda t: t["end_seq"]), _greatest_so_far), lambda ends: select(
                lambda n: test(n) & F.coalesce(F.get(ends, _count_before(begins, n["seq"]) - 1) >= n["seq"], F.lit(False)))))
    return let(select(above), under)


def listing_cards() -> Column:
    """One struct of listing fields per card."""
    def card_fields(card: Column, named: Column, begins: Column) -> Column:
        def link_where(test) -> Column:
            return first(lambda n: is_link(n) & test(F.lower(raw_text_of(n))), card)["href"]

        def of(name: Column) -> Column:
            second = F.get(select(
                lambda n: (n["tag"] == "p") & (n["parent_seq"] == card["seq"]), card), F.lit(1))
            return F.struct(
                blank(raw_text_of(name)).alias("name"),
                blank(name["href_abs"]).alias("detail_url"),
                text_or_blank(second).alias("listing_address"),
                blank(let(first(with_class("langs"), card), raw_text_of)).alias("listing_languages"),
                blank(link_where(lambda t: F.contains(t, F.lit("map")))).alias("map_url"),
                blank(link_where(lambda t: t == "website")).alias("listing_website"),
            )
        following = let(F.get(named, _count_before(begins, card["seq"])), lambda n: F.when(n["seq"] <= card["end_seq"], n))
        return let(following, of)

    return let(nodes_under(tagged("a"), with_class("partner-name")), lambda named: let(
        F.transform(named, lambda n: n["seq"]), lambda begins: F.transform(
            select(with_class("partner-element")), lambda card: card_fields(card, named, begins))))


def heading_list(text: str) -> Column:
    """List items below the parent of the first h2/h3 with exactly this text."""
    heading = first(lambda n: n["tag"].isin(*HEADINGS) & (raw_text_of(n) == text))
    items = let(heading, lambda h: F.filter(_below(h["parent_seq"]), lambda n: n["tag"] == "li"))
    return F.transform(F.coalesce(items, F.slice("nodes", 1, 0)), raw_text_of)


def property_entries() -> Column:
    """Label/value pairs of the page in document order."""
    nodes = F.col("nodes")

    def entry(label: Column) -> Column:
        parent = F.get(nodes, F.greatest(label["parent_seq"], F.lit(0)))
        full = F.when(label["parent_seq"] < 0, F.col("text")).otherwise(text_of(parent))
        return let(raw_text_of(label), lambda name: F.struct(
            name.alias("label"), clean_text(remove_prefix(full, name)).alias("value")))

    return F.transform(select(with_class("prop-title")), entry)


def property_value(entries: Column, label: str) -> Column:
    """Value of the last entry with this label."""
    hits = F.filter(entries, lambda e: e["label"] == label)
    return blank(F.try_element_at(hits, F.lit(-1))["value"])


def partner_detail_fields() -> dict[str, Column]:
    """The detail-page columns that do not depend on the listing."""
    props, contact = F.col("properties"), F.col("contact")

    def in_contact(test: Test, read) -> Column:
        return let(contact, lambda c: let(first(test, c), read))

    def href_starts(prefix: str) -> Test:
        return lambda n: is_link(n) & F.startswith(n["href"], F.lit(prefix))

    updated = let(first(GUIDANCE_UPDATED), raw_text_of)
    return {
        "services": heading_list("Offered service(s)"),
        "regular_staff_languages": property_value(props, "By regular personal"),
        "casual_volunteer_languages": property_value(props, "By casual and voluntary personal"),
        "reduced_mobility_access": property_value(props, "Access for people with reduced mobility"),
        "daycare": property_value(props, "Daycare center"),
        "contact_hours": blank(in_contact(with_class("date-section"), text_of)),
        "phone": blank(in_contact(href_starts("tel:"), raw_text_of)),
        "email": blank(in_contact(href_starts("mailto:"), lambda n: remove_prefix(n["href"], "mailto:"))),
        "contact_website": in_contact(
            lambda n: href_starts("http")(n) & ~F.contains(F.lower(n["href"]), F.lit("map")),
            lambda n: n["href"]),
        "contact_address": in_contact(with_class("address"), text_of),
        "holiday_period": property_value(props, "Holiday period"),
        "territory_covered": property_value(props, "Territory covered by the organization"),
        "administrative_region": property_value(props, "Administrative region"),
        "municipality": property_value(props, "Municipality"),
        "source_last_updated": F.trim(remove_prefix(blank(updated), UPDATED_PREFIX)),
    }
