"""The queries of ``queries.py`` as SQL for an independent engine.

``VIEWS`` maps the given tables to the entities, as ``tables.py`` does; a query
names the views it needs and gets them as common table expressions.
"""

from __future__ import annotations

import re

AS_OF = "date '2001-08-01'"

VIEWS = {
    "vehicles": """
        select c_custkey as id, c_name as vin, c_mktsegment as brand,
          'M' || cast(c_custkey % 5 as varchar) as model,
          'N' || cast(c_nationkey as varchar) || '-' || cast(c_custkey as varchar) as plate,
          n_name as dealer,
          date '1993-01-01' + cast((c_custkey * 37) % 2000 as int) as warranty_start,
          case when c_mktsegment = 'MACHINERY' then 60 else 72 end as whole_months,
          case when c_mktsegment = 'MACHINERY' then 120000 else 150000 end as whole_km,
          96 as ev_months,
          case when c_mktsegment = 'MACHINERY' then 200000 else 240000 end as ev_km,
          cast(floor(abs(c_acctbal) * 25) as int) as mileage
        from customer left join nation on c_nationkey = n_nationkey""",
    "claim_heads": """
        select 'CLM-' || cast(year(o_orderdate) as varchar) || '-'
            || lpad(cast(o_orderkey as varchar), 15, '0') as no,
          o_orderkey as claim_id, o_custkey as vehicle_id, o_orderpriority as fault,
          cast(o_orderdate as date) as date, o_orderstatus as stage,
          case when o_orderstatus = 'F' then
                 case substr(o_orderpriority, 1, 1)
                   when '1' then 'Approved' when '2' then 'Approved' when '3' then 'Partial'
                   when '4' then 'Shipped' else 'Closed' end
               when o_orderstatus = 'O' then
                 case substr(o_orderpriority, 1, 1)
                   when '1' then 'Submitted' when '5' then 'Draft' else 'Under Review' end
               when substr(o_orderpriority, 1, 1) in ('1', '2', '3') then 'Rejected'
               else 'Under Review' end as status
        from orders""",
    "claims": """
        select no, claim_id, c_name as vehicle, 'M' || cast(c_custkey % 5 as varchar) as model,
          fault, n_name as dealer, date, status
        from claim_heads left join customer on vehicle_id = c_custkey
        left join nation on n_nationkey =
          (c_nationkey + case when claim_id % 10 = 0 then 1 else 0 end) % 25""",
    "parts": """
        select p_partkey as part_id,
          p_brand || '-' || lpad(cast(p_partkey as varchar), 12, '0') as oe,
          p_name as name, p_type as cat, p_brand as brand, p_size <= 5 as wear,
          case when p_size <= 5 then 'Wear Item'
               when p_type in ('PROMO', 'ECONOMY') then 'EV Core (96mo)'
               else 'General (72mo)' end as warranty,
          'M' || cast(p_partkey % 5 as varchar) || ', M' || cast((p_partkey + 1) % 5 as varchar)
            as models
        from part""",
    "claim_parts": """
        select no, coalesce(oe, 'UNKNOWN-' || lpad(cast(l_partkey as varchar), 12, '0')) as oe,
          cast(sum(l_quantity) as bigint) as qty
        from lineitem left join claim_heads on l_orderkey = claim_id left join parts on l_partkey = part_id
        group by l_orderkey, no, oe, l_partkey""",
    "nested_lines": """
        select no, claim_id, k,
          'OE-' || lpad(cast((claim_id * 31 + case when claim_id % 7 = 0 then 0 else k end) % 2100 as varchar), 12, '0') as oe,
          cast(1 + (claim_id + k) % 5 as int) as qty
        from claim_heads, (values (0), (1), (2)) as places(k)
        where k < claim_id % 4 and claim_id % 29 <> 0""",
    "nested_catalogue": """
        select 'OE-' || lpad(cast(part_id as varchar), 12, '0') as oe, name, warranty, wear from parts""",
    "inventory": """
        select 'SKU-' || cast(p_partkey as varchar) as sku,
          p_brand || '-' || lpad(cast(p_partkey as varchar), 12, '0') as oe, p_name as name,
          cast((p_partkey * 13) % 60 as int) as qty,
          'WH-' || cast(p_partkey % 7 as varchar) as location, p_size as safety
        from part""",
    "shipments": """
        select 'SHP-' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as no,
          claim_heads.no as claim, p_name as part, cast(l_quantity as int) as qty,
          s_name as carrier,
          case l_returnflag when 'R' then 'In Transit' when 'A' then 'Delivered'
            else 'Pending' end as status,
          cast(l_shipdate as date) as eta
        from lineitem left join claim_heads on l_orderkey = claim_id
        left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey
        where l_linestatus = 'F'""",
    "maintenance": """
        select c_name as vin, cast(ts - interval '27' year as date) as date,
          cast(floor(value * 40) as int) as km,
          case event_type when 'signup' then 'Delivery / PDI completed'
            when 'view' then 'Routine maintenance (first service)'
            else 'Software update & inspection' end as title
        from events left join customer on user_id = c_custkey where event_type <> 'error'""",
    "accidents": """
        select c_name as vin, cast(ts - interval '27' year as date) as date
        from events left join customer on user_id = c_custkey
        where event_type = 'error' and event_id % 40 = 0""",
    "decisions": """
        select case when claim_id % 43 = 0 and later = 0 then no || '-X' else no end as claim,
          case when later = 1 and claim_id % 37 = 0 then 'Postponed'
            when later = 1 and claim_id % 41 = 0 then null
            when (claim_id + later) % 3 = 0 then 'Approved'
            when (claim_id + later) % 3 = 1 then 'Partial' else 'Rejected' end as decision,
          case when (claim_id + later) % 11 = 0 then '' else 'note' end as note,
          date + later as decided_on
        from claim_heads, (values (0), (1)) as times(later)
        where status in ('Submitted', 'Under Review') and claim_id % 2 = 0""",
    "claim_events": """
        select no as claim, date as "at", 'Submitted' as event from claim_heads
        union all select no, date + 1, 'Cancelled' from claim_heads where claim_id % 53 = 0
        union all select claim, decided_on, decision from decisions
          where note <> '' and decision in ('Approved', 'Partial', 'Rejected')
        union all select claim, eta, 'Shipped' from shipments
        union all select claim, eta + 10, 'Closed' from shipments where status = 'Delivered'""",
    # One event of a claim after the other, each from the status before it.
    "walked": """
        with alike as (
          select claim, "at", event, count(*) as times,
            coalesce(list_position(['Draft', 'Submitted', 'Under Review', 'Approved', 'Partial',
              'Rejected', 'Shipped', 'Closed'], event), 9) as place
          from claim_events where claim is not null group by claim, "at", event),
        lives as (
          select claim, list({'at': "at", 'event': event, 'times': times} order by "at", place, event) as life
          from alike group by claim),
        states as (
          select claim, life, list_reduce(list_transform(life, lambda e: [e.event]), lambda path, e: list_append(path,
            case when list_contains(case path[-1]
                when 'Draft' then ['Submitted']
                when 'Submitted' then ['Under Review', 'Approved', 'Partial', 'Rejected']
                when 'Under Review' then ['Approved', 'Partial', 'Rejected']
                when 'Approved' then ['Shipped', 'Closed'] when 'Partial' then ['Shipped', 'Closed']
                when 'Rejected' then ['Closed'] when 'Shipped' then ['Closed']
                else ['none'] end, e[1]) then e[1] else path[-1] end), ['Draft']) as path
          from lives),
        steps as (
          select claim, unnest(life) as e, unnest(path[:-2]) as before, unnest(path[2:]) as after from states)
        select claim, e['at'] as "at", e.event as event, e.times as times, before, after,
          e.times - case when before <> after then 1 else 0 end as illegal
        from steps""",
    "outbound": """
        select 'OUT-' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar)
            as order_id,
          case when l_orderkey % 41 <> 0 then oe end as oe,
          case when l_orderkey % 31 = 0 then null when l_orderkey % 37 = 0 then -1 else 1 end as qty
        from lineitem left join parts on l_partkey = part_id
        where l_linestatus = 'O' and l_returnflag = 'N'""",
    "new_claims": """
        select no as id,
          case when claim_id % 13 = 0 then null when claim_id % 17 = 0 then -1
            else vehicle_id end as vehicle_id,
          case when claim_id % 19 = 0 then '' when claim_id % 23 = 0 then ' '
            else fault end as fault_desc,
          cast(null as varchar) as diagnosis
        from claim_heads where stage = 'O'""",
    # The check in another way than the operators do it: every claim line against
    # every event of its vehicle.
    "marks": """
        select c.no, c.status, c.date, c.vehicle,
          coalesce(v.dealer = c.dealer, false) as id_ok,
          coalesce(c.date >= v.warranty_start and v.mileage <= v.ev_km and
            c.date <= cast(v.warranty_start + to_months(v.ev_months) as date), false) as ev_ok,
          coalesce(c.date >= v.warranty_start and v.mileage <= v.whole_km and
            c.date <= cast(v.warranty_start + to_months(v.whole_months) as date), false)
            as whole_ok,
          not exists (select 1 from accidents a where a.vin = c.vehicle and a.date <= c.date)
            as accident_ok,
          exists (select 1 from maintenance m where m.vin = c.vehicle and m.date <= c.date
            and m.title like '%first service%') as service_ok
        from claims c left join vehicles v on v.vin = c.vehicle""",
    "check_rows": """
        select m.no, m.status, cp.oe, cp.qty,
          case when p.warranty like 'EV Core%' then 'EV Core'
               when p.warranty like 'General%' then 'General'
               when p.warranty like 'Wear Item%' then 'Wear Item' end as class,
          case when m.id_ok then 'ok' else 'bad' end as identity,
          case when cp.oe is null then null
               when p.oe is null then 'bad'
               when case when p.warranty like 'EV Core%' then m.ev_ok else m.whole_ok end
               then 'ok' else 'bad' end as term,
          case when cp.oe is null then null when p.wear or p.oe is null then 'bad' else 'ok' end as wear,
          case when m.accident_ok then 'ok' else 'warn' end as accident,
          case when m.service_ok then 'ok' else 'warn' end as service
        from marks m left join claim_parts cp on cp.no = m.no left join parts p on p.oe = cp.oe""",
    "waiting": """
        select * from claims where status in ('Approved', 'Partial')
          and no not in (select claim from shipments where claim is not null)""",
    "requests": """
        select r.no as claim, r.oe, p.name as part, r.qty, 'Pending' as status
        from check_rows r join waiting w on w.no = r.no left join parts p on p.oe = r.oe
        where r.oe is not null and (r.status = 'Approved' or (r.term = 'ok' and r.wear = 'ok'))""",
    "intake": """
        select n.*, v.vin, v.model, v.dealer,
          case when n.vehicle_id is null then 'no vehicle'
               when n.fault_desc = '' then 'no fault'
               when v.vin is null then 'unknown vehicle' end as reason
        from new_claims n left join vehicles v on v.id = n.vehicle_id""",
}

PART_COLUMNS = "part_id, oe, name, cat, brand, wear, warranty, models"
VEHICLE_COLUMNS = (
    "id, vin, brand, model, plate, dealer, warranty_start, whole_months, whole_km, "
    "ev_months, ev_km, mileage"
)
CLAIM_COLUMNS = "no, claim_id, vehicle, model, fault, dealer, date, status"
PART_CARD = """select name, oe,
  cat || ' · ' || case when wear then '⚠️ Wear Item' else warranty end as meta, brand, models
  from parts"""

VEHICLE_PAGE = """
        with covers as (
          select vin, 1 as place, 'Whole Vehicle' as cover, whole_months as months, whole_km as km,
            warranty_start, mileage from vehicles where {which}
          union all
          select vin, 2, 'EV Components (Battery / Motor / ECU)', ev_months, ev_km,
            warranty_start, mileage from vehicles where {which})
        select vin, 'profile' as section, null::date as day, brand || ' ' || model as title,
          'Plate ' || plate || ' · Sold ' || warranty_start || ' · ' || format('{{:,}}', mileage) || ' km' as detail
        from vehicles where {which}
        union all
        select vin, 'cover', warranty_start, cover,
          months || ' months / ' || format('{{:,}}', km) || ' km · '
          || case when {as_of} >= warranty_start and mileage <= km
               and {as_of} <= cast(warranty_start + to_months(months) as date)
             then 'In Warranty' else 'Out of Warranty' end
        from covers
        union all
        select v.vin, 'service', m.date, m.title,
          strftime(m.date, '%Y-%m-%d') || ' · ' || format('{{:,}}', m.km) || ' km'
        from maintenance m join vehicles v on v.vin = m.vin where {which}
        union all
        select v.vin, 'claim', c.date, coalesce(c.no, 'No claims'), c.fault || ' · ' || c.status
        from vehicles v left join claims c on c.vehicle = v.vin where {which}"""

SQL = {
    "scan_vehicles": "select * from vehicles",
    "scan_claims": "select * from claims",
    "scan_claims_nested": """
        select c.*, case when claim_id % 29 <> 0 then coalesce((select string_agg(oe || ' x' || qty, ', ' order by k)
          from nested_lines l where l.no = c.no), '') end as parts from claims c""",
    "scan_parts": "select * from parts",
    "scan_inventory": "select * from inventory",
    "scan_shipments": "select * from shipments",
    "scan_maintenance": "select * from maintenance",
    "vehicle_list": f"""select vin, brand, model, plate, format('{{:,}}', mileage) || ' km' as mileage,
        case when {AS_OF} < warranty_start then 'Out of Warranty'
             when mileage <= whole_km
               and {AS_OF} <= cast(warranty_start + to_months(whole_months) as date)
             then 'In Warranty'
             when mileage <= ev_km
               and {AS_OF} <= cast(warranty_start + to_months(ev_months) as date)
             then 'In Warranty' else 'Out of Warranty' end as status
        from vehicles""",
    "vehicle_profile": """select brand, model, vin, plate, warranty_start as sale_date,
        format('{:,}', mileage) || ' km' as mileage from vehicles""",
    "vehicle_picker": "select id, vin || ' · ' || model as label from vehicles",
    "claim_list": "select no, model, vehicle, fault, date, status from claims",
    "part_cards": PART_CARD,
    "part_cards_unknown": """select case when part_id % 7 <> 0 then name end as name, oe,
        case when part_id % 3 <> 0 then cat else '' end || ' · '
        || case when wear then '⚠️ Wear Item' when part_id % 5 <> 0 then warranty else '' end as meta, brand, models
        from parts""",
    "vehicle_picker_unknown": """select id, vin || ' · ' || case when id % 3 <> 0 then model else '' end as label
        from vehicles""",
    "part_labels": """select oe, warranty,
        case when wear then 'Wear Item' when cat in ('PROMO', 'ECONOMY') then 'EV Core'
          else 'General' end as class,
        case when wear then null when cat in ('PROMO', 'ECONOMY') then 96 else 72 end as months
        from parts""",
    "part_picker": "select name, oe from parts order by oe limit 5",
    "stock_level": """select sku, oe, name, qty, location,
        case when qty > safety then 'OK' else 'Low' end as level from inventory""",
    "shipment_list": "select no, claim, part, qty, carrier, status, eta from shipments",
    "vehicle_badges": "select vin, 'In Warranty' as status, 'b-gray' as badge from vehicles",
    "one_vehicle": f"select {VEHICLE_COLUMNS} from vehicles where id = 1024",
    "api_envelope": """select sku, oe, qty from inventory
        where cast(substr(sku, 5) as bigint) % 9 <> 0 and cast(substr(sku, 5) as bigint) % 7 <> 0""",
    "api_rows": """select sku, oe, qty from inventory
        where cast(substr(sku, 5) as bigint) % 11 in (0, 10)""",
    "api_rejects": """
        with bodies as (
          select sku as asked, cast(substr(sku, 5) as bigint) % 11 as kind,
            '{"success":true,"data":[{"sku":"' || sku || '","oe":"' || oe || '","qty":' || cast(qty as varchar) || '}]}' as good
          from inventory)
        select asked,
          case kind when 2 then '  ' when 3 then substr(good, 1, 30)
            when 4 then replace(good, '"qty":', '"qty":"many","was":') when 5 then '[' || good || ']'
            when 6 then replace(good, 'true', 'false') when 7 then '{"success":true,"data":null}'
            when 8 then replace(good, '"success":true,', '') end as body,
          case when kind in (1, 2) then 'no body' when kind = 3 then 'not JSON'
            when kind in (4, 5) then 'wrong type' when kind in (6, 8) then 'not successful' else 'no data' end as reason
        from bodies where kind between 1 and 8""",
    "status_class": """
        with badges(status, badge) as (values ('Draft', 'b-gray'), ('Submitted', 'b-blue'),
          ('Under Review', 'b-amber'), ('Approved', 'b-green'), ('Partial', 'b-teal'),
          ('Rejected', 'b-red'), ('Shipped', 'b-indigo'), ('Closed', 'b-gray'),
          ('In Transit', 'b-blue'), ('Delivered', 'b-green'), ('Pending', 'b-amber')),
        statuses as (select 'claim' as kind, no, status from claim_heads
          union all select 'shipment', no, status from shipments)
        select kind, no, statuses.status, coalesce(badge, 'b-gray') as badge
        from statuses left join badges on statuses.status = badges.status""",
    "recent_claims": """select no, model, status, date from claims
        order by date desc, no desc limit 4""",
    "maintenance_timeline": """select vin, date, km,
        strftime(date, '%Y-%m-%d') || ' · ' || format('{:,}', km) || ' km' as "when", title
        from maintenance""",
    "escaped_text": """
        with texts as (select doc_id, text, 'document' as kind from documents
          union all select page_id, html, 'page' from pages)
        select doc_id, kind, replace(replace(replace(replace(replace(coalesce(text, ''),
          '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as text
        from texts""",
    "vehicle_search": f"""select {VEHICLE_COLUMNS} from vehicles
        where vin ilike '%n1-%' or plate ilike '%n1-%'""",
    "claim_search": f"""select {CLAIM_COLUMNS} from claims
        where no ilike '%clm-1997-%' or vehicle ilike '%clm-1997-%'""",
    "claim_search_trigrams": f"""select {CLAIM_COLUMNS} from claims
        where contains(lower(no), 'clm-1997-') or contains(lower(vehicle), 'clm-1997-')""",
    "vehicle_search_trigrams": f"""select {VEHICLE_COLUMNS} from vehicles
        where contains(lower(vin), 'n1-') or contains(lower(plate), 'n1-')""",
    "inventory_search": """select * from inventory
        where sku ilike '%brand#1%' or oe ilike '%brand#1%'""",
    "part_search": f"""select {PART_COLUMNS} from parts
        where brand = 'Brand#2' and (oe ilike '%ring%' or name ilike '%ring%')""",
    "part_search_literal": f"""select {PART_COLUMNS} from parts
        where strpos(oe, '%') > 0 or strpos(name, '%') > 0""",
    "part_search_all": PART_CARD,
    "claims_by_status": f"select {CLAIM_COLUMNS} from claims where status = 'Approved'",
    "pending_review_queue": """select no, model, vehicle, fault, date, status from claims
        where status = 'Under Review'""",
    "low_stock": "select * from inventory where not qty > safety",
    "dealer_vehicles": f"select {VEHICLE_COLUMNS} from vehicles where dealer = 'NATION_3'",
    "dealer_claims": """select c.no, v.dealer, c.vehicle, c.model, c.fault, c.status
        from claims c join vehicles v on c.vehicle = v.vin
        where v.dealer = 'NATION_3' and c.status = 'Under Review'""",
    "related_claims": """select v.vin, coalesce(c.no, 'No claims') as claim, c.fault, c.status
        from vehicles v left join claims c on c.vehicle = v.vin""",
    "vehicle_page": VEHICLE_PAGE.format(which="id = 1024", as_of=AS_OF),
    "vehicle_pages": VEHICLE_PAGE.format(which="brand = 'MACHINERY'", as_of=AS_OF),
    "vehicle_by_id": f"""select {VEHICLE_COLUMNS} from vehicles
        where id in (select vehicle_id from new_claims where vehicle_id is not null)""",
    "review_queue_dealer": """select c.no, v.dealer, c.vehicle, c.model, c.fault, c.status
        from claims c join vehicles v on c.vehicle = v.vin where c.status = 'Under Review'""",
    "claimed_parts": """select h.no, cp.oe, p.name, cp.qty, p.warranty
        from claim_heads h left join claim_parts cp on cp.no = h.no
        left join parts p on p.oe = cp.oe
        union all
        select cp.no, cp.oe, p.name, cp.qty, p.warranty
        from claim_parts cp left join parts p on p.oe = cp.oe where cp.no is null""",
    "claimed_parts_nested": """select h.no, l.oe, p.name, l.qty, p.warranty
        from claim_heads h left join nested_lines l on l.no = h.no
        left join nested_catalogue p on p.oe = l.oe""",
    "shipments_with_claim": """select s.no, s.claim, s.part, s.qty, s.carrier, s.status, s.eta,
        c.vehicle, c.model, c.status as claim_status
        from shipments s join claims c on c.no = s.claim""",
    "warranty_cover": f"""
        with covers as (
          select vin, 'Whole Vehicle' as cover, whole_months as months, whole_km as km,
            warranty_start, mileage from vehicles
          union all
          select vin, 'EV Components (Battery / Motor / ECU)', ev_months, ev_km,
            warranty_start, mileage from vehicles)
        select vin, cover, months, km,
          cast(months as varchar) || ' months / ' || format('{{:,}}', km) || ' km' as terms,
          warranty_start,
          case when {AS_OF} >= warranty_start and mileage <= km
                and {AS_OF} <= cast(warranty_start + to_months(months) as date)
               then 'In Warranty' else 'Out of Warranty' end as state
        from covers""",
    "vehicle_record": """
        select vin, dealer as holder, warranty_start, mileage, whole_months, whole_km,
          ev_months, ev_km,
          (select min(date) from maintenance m
            where m.vin = v.vin and m.title like '%first service%') as first_service,
          (select min(date) from accidents a where a.vin = v.vin) as first_accident
        from vehicles v""",
    "warranty_check": "select * from check_rows",
    "review_card": """
        with facts as (
          select r.*, v.vin, v.dealer as holder, p.name, p.wear as wear_part,
            format('{:,}', v.mileage) as km,
            case when r.class = 'EV Core'
              then 'EV ' || v.ev_months || 'mo / ' || format('{:,}', v.ev_km)
              when r.class is not null
              then 'Whole Vehicle ' || v.whole_months || 'mo / ' || format('{:,}', v.whole_km)
              end as terms,
            (select min(date) from accidents a where a.vin = m.vehicle) as crashed,
            (select min(date) from maintenance s
              where s.vin = m.vehicle and s.title like '%first service%') as served
          from check_rows r join marks m on m.no = r.no
          left join vehicles v on v.vin = m.vehicle left join parts p on p.oe = r.oe)
        select no, oe, 1 as step, 'Vehicle Identity' as "check", identity as mark,
          case when holder is null then 'VIN not in any dealer inventory'
               when identity = 'ok' then 'VIN matches dealer inventory · ' || holder
               else 'VIN held by another dealer · ' || holder end as detail from facts
        union all
        select no, oe, 2, 'Warranty Term / Mileage', term,
          case when oe is not null then coalesce(km || ' km · '
            || case when term = 'ok' then 'within ' else 'outside ' end || terms || ' km',
            'No cover known') end from facts
        union all
        select no, oe, 3, 'Wear / Exclusion', wear,
          case when oe is not null then coalesce(name || case when wear_part then ' is a wear item'
            else ' is ' || class || ' — not a wear item' end, 'Part not in the catalogue') end from facts
        union all
        select no, oe, 4, 'Human / Accident', accident,
          case when accident = 'ok' then 'No accident record; pending manual confirm'
               else 'Accident on record (' || crashed || ')' end from facts
        union all
        select no, oe, 5, 'Maintenance Compliance', service,
          case when service = 'ok' then 'First service on record (' || served || ')'
               else 'No first service on record' end from facts""",
    "warranty_recommendation": """
        with per_claim as (
          select no, count(oe) as parts,
            count(case when term = 'ok' and wear = 'ok' then 1 end) as passing,
            bool_or(identity = 'bad') as wrong,
            bool_or(accident = 'warn' or service = 'warn') as unclear
          from check_rows group by no)
        select no, parts, passing,
          case when wrong or (parts > 0 and passing = 0) then 'Reject'
               when passing < parts then 'Partial'
               when parts = 0 or unclear then 'Manual' else 'Approve' end as recommendation
        from per_claim""",
    "recommendation_nested": """
        with lines as (
          select l.no, p.warranty, p.wear from nested_lines l left join nested_catalogue p on p.oe = l.oe),
        per_claim as (
          select m.no, count(l.no) as parts,
            count(*) filter (where not l.wear and case when l.warranty like 'EV Core%' then m.ev_ok else m.whole_ok end)
              as passing,
            bool_or(not m.id_ok) as wrong, bool_or(not m.accident_ok or not m.service_ok) as unclear
          from marks m left join lines l on l.no = m.no group by m.no)
        select no, parts, passing,
          case when wrong or (parts > 0 and passing = 0) then 'Reject'
               when passing < parts then 'Partial'
               when parts = 0 or unclear then 'Manual' else 'Approve' end as recommendation
        from per_claim""",
    "claims_per_status": "select status, count(*) as claims from claim_heads group by status",
    "active_vehicles": f"""
        select dealer, count(*) filter (where {AS_OF} >= warranty_start and (
            ({AS_OF} <= cast(warranty_start + to_months(whole_months) as date)
              and mileage <= whole_km)
            or ({AS_OF} <= cast(warranty_start + to_months(ev_months) as date)
              and mileage <= ev_km))) as active_vehicles
        from vehicles group by dealer""",
    "low_stock_count": "select count(*) as low_stock_skus from inventory where qty <= safety",
    "claims_this_week": """
        select cast(date_trunc('week', max(date)) as date) as week,
          (select count(*) from claim_heads where date_trunc('week', date) =
            (select date_trunc('week', max(date)) from claim_heads)) as claims
        from claim_heads""",
    "claims_in_week": f"""select cast(date_trunc('week', {AS_OF}) as date) as week,
        count(*) as claims from claim_heads
        where date_trunc('week', date) = date_trunc('week', {AS_OF})""",
    "admin_kpis": """select
        (select count(*) from claim_heads where status = 'Under Review') as pending_review,
        (select count(*) from claim_heads where status in ('Approved', 'Partial')
          and no not in (select claim from shipments where claim is not null)) as awaiting_writeoff,
        (select count(*) from inventory where qty <= safety) as low_stock_skus,
        (select count(*) from claim_heads where date_trunc('week', date) =
          (select date_trunc('week', max(date)) from claim_heads)) as claims_this_week""",
    "admin_kpis_partials": """select
        count(*) filter (status = 'Under Review') as pending_review,
        count(*) filter (status in ('Approved', 'Partial') and no not in (select claim from shipments where claim is not null)) as awaiting_writeoff,
        (select count(*) from inventory where qty <= safety) as low_stock_skus,
        count(*) filter (date_trunc('week', date) = (select date_trunc('week', max(date)) from claim_heads))
          as claims_this_week
        from claim_heads""",
    "claim_partials": """select date, dealer, status,
        status in ('Approved', 'Partial') and no in (select claim from shipments where claim is not null) as shipped, count(*) as n
        from claims group by all""",
    "dealer_kpis": f"""
        with dealers as (select dealer from claims union select dealer from vehicles)
        select d.dealer,
          (select count(*) from claims c where c.dealer is not distinct from d.dealer
            and c.status = 'Under Review') as under_review,
          (select count(*) from claims c where c.dealer is not distinct from d.dealer
            and c.status = 'Approved') as approved,
          (select count(*) from claims c where c.dealer is not distinct from d.dealer
            and c.status = 'Shipped') as shipped,
          (select count(*) from vehicles v where v.dealer is not distinct from d.dealer
            and {AS_OF} >= warranty_start and (
            ({AS_OF} <= cast(warranty_start + to_months(whole_months) as date)
              and mileage <= whole_km)
            or ({AS_OF} <= cast(warranty_start + to_months(ev_months) as date)
              and mileage <= ev_km))) as active_vehicles
        from dealers d""",
    "claim_intake": f"""select id as no, vin as vehicle, model, fault_desc as fault,
        'Submitted' as status, {AS_OF} as date, diagnosis, dealer
        from intake where reason is null""",
    "intake_rejects": """select id, vehicle_id, fault_desc, diagnosis, reason
        from intake where reason is not null""",
    "intake_numbers_in_use": """
        with forms as (
          select id, vehicle_id, fault_desc from new_claims
          union all select no, vehicle_id, fault from claim_heads
          where stage <> 'O' and claim_id % 11 = 0)
        select f.id,
          case when f.vehicle_id is null then 'no vehicle'
               when f.fault_desc = '' then 'no fault'
               when v.vin is null then 'unknown vehicle'
               when f.id in (select no from claim_heads where stage <> 'O') then 'number taken'
          end as reason
        from forms f left join vehicles v on v.id = f.vehicle_id""",
    "claims_after_intake": f"""
        select no, vehicle, model, fault, dealer, date, status from claims
        where no in (select no from claim_heads where stage <> 'O')
        union all select id, vin, model, fault_desc, dealer, {AS_OF}, 'Submitted' from intake where reason is null""",
    "claim_items": """select no as claim,
        string_agg(oe || ' x' || cast(qty as varchar), ', ' order by oe) as items
        from claim_parts group by no""",
    "claim_intake_items": """select id as no, oe, qty
        from intake left join nested_lines on no = id where reason is null""",
    "claim_payload_json": """
        select id, '{"vehicle_id":' || coalesce('"' || cast(vehicle_id as varchar) || '"', 'null')
          || ',"fault_desc":"' || fault_desc || '","diagnosis":null,"items":['
          || coalesce(string_agg('{"oe_no":"' || oe || '","qty":' || cast(qty as varchar) || '}', ','
               order by oe), '') || ']}' as payload
        from new_claims left join claim_parts on no = id
        group by id, vehicle_id, fault_desc""",
    "claim_payload_pieces": """
        with counted as (
          select id, vehicle_id, fault_desc, cast(greatest(1, ceil(count(oe) / 2.0)) as bigint) as pieces
          from new_claims left join claim_parts on no = id group by id, vehicle_id, fault_desc),
        dealt as (
          select id, oe, qty,
            cast('0x' || substr(md5(oe || '/' || cast(qty as varchar) || '/0'), 1, 8) as bigint) % pieces as piece
          from counted join claim_parts on no = id),
        lists as (
          select id, piece, count(*) as items, min(piece) over (partition by id) as opened,
            string_agg('{"oe_no":"' || oe || '","qty":' || cast(qty as varchar) || '}', ',' order by oe) as list
          from dealt group by id, piece),
        each as (
          select *, unnest(generate_series(0, pieces - 1)) as piece from counted)
        select e.id, e.piece, e.pieces, coalesce(l.items, 0) as items,
          case when e.piece = 0 then '{"vehicle_id":' || coalesce('"' || cast(vehicle_id as varchar) || '"', 'null')
            || ',"fault_desc":"' || fault_desc || '","diagnosis":null,"items":[' else '' end
          || case when l.piece > l.opened then ',' else '' end || coalesce(list, '')
          || case when e.piece = e.pieces - 1 then ']}' else '' end as body
        from each e left join lists l on l.id = e.id and l.piece = e.piece""",
    "payload_round_trip": """select id as no, oe, cast(qty as int) as qty
        from intake join claim_parts on no = id where reason is null""",
    "accepted_lines": """select no as claim, oe as oe_no, qty
        from claim_parts where no in (select id from intake where reason is null)""",
    "claim_status_after_review": """
        with newest as (select *, row_number() over (partition by claim
            order by decided_on desc, decision desc) as rank
          from decisions where note <> '' and decision in ('Approved', 'Partial', 'Rejected'))
        select h.no, case when h.status in ('Submitted', 'Under Review')
          then coalesce(n.decision, h.status) else h.status end as status
        from claim_heads h left join newest n on n.claim = h.no and n.rank = 1""",
    "decision_log": """select claim, decision, note, decided_on from decisions
        where note <> '' and decision in ('Approved', 'Partial', 'Rejected')
          and claim in (select no from claim_heads)""",
    "decision_rejects": """select * from (
          select claim, decision, note, case when note = '' then 'no note'
            when decision is null or decision not in ('Approved', 'Partial', 'Rejected')
              then 'unknown decision'
            when claim not in (select no from claim_heads) then 'unknown claim' end as reason
          from decisions) where reason is not null""",
    "claim_states": """select claim, arg_max(after, n) as status,
        cast(sum(times) as bigint) as events, cast(sum(illegal) as bigint) as illegal
        from (select *, row_number() over () as n from walked) group by claim""",
    "claim_history": """select claim, "at", event, times, before, after, illegal from walked""",
    "illegal_moves": """select claim, "at", event, after as status, illegal as times
        from walked where illegal > 0""",
    "awaiting_writeoff": "select no, vehicle, model, status, date from waiting",
    "writeoff_orders": """select w.no as claim, w.vehicle, w.model, 'Replace part' as settlement,
        count(r.oe) as parts, cast(coalesce(sum(r.qty), 0) as bigint) as qty
        from waiting w left join requests r on r.claim = w.no
        group by w.no, w.vehicle, w.model""",
    "shipment_requests": "select * from requests",
    "booked_shipments": """select 'SHP-' || claim || '/' || oe as no, claim, part, qty, status
        from requests where claim not like '%7'""",
    "claims_after_shipment": """select no, vehicle,
        case when no in (select claim from requests) then 'Shipped' else status end as status from claims""",
    "writeoff_stock": """select r.claim, r.oe, r.part, r.qty, i.qty as qty_on_hand,
        coalesce(i.qty >= r.qty, false) as in_stock
        from requests r left join inventory i on i.oe = r.oe""",
    "outbound_rejects": """select * from (
          select order_id, oe, qty, case
            when oe is null or oe not in (select oe from inventory) then 'unknown part'
            when qty is null then 'no quantity' when qty <= 0 then 'not positive' end as reason
          from outbound) where reason is not null""",
    "stock_after_outbound": """
        select i.*, cast(coalesce(t.taken, 0) as bigint) as taken_out,
          cast(i.qty - coalesce(t.taken, 0) as bigint) as on_hand,
          i.qty < coalesce(t.taken, 0) as short
        from inventory i left join (select oe, sum(qty) as taken from outbound where qty > 0
          group by oe) t
          on t.oe = i.oe""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in SQL.items()}


def _with_views(sql: str) -> str:
    """The query behind the views it names, directly or through others."""
    needed = [name for name in VIEWS if name in _closure(sql)]
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
    sql = sql.strip()
    if sql.startswith("with "):
        return f"with {views},\n{sql[5:]}" if views else sql
    return f"with {views}\n{sql}" if views else sql


def _closure(sql: str) -> set[str]:
    names: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        found = {name for name in VIEWS if re.search(rf"\b{name}\b", text)} - names
        names |= found
        todo += [VIEWS[name] for name in found]
    return names
