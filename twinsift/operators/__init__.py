"""Work on whole tables: joins, grouping, roll-ups, life cycle, contacts, compression plans."""
