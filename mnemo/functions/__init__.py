"""Part of mnemo."""
