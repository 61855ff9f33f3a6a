"""keepsake: set-at-a-time operators over a store of captured items.

Every operator takes DataFrames and returns DataFrames; nothing here runs an
action on a table that grows with the store.
"""
