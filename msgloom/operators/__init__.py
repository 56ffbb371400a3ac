"""DataFrame to DataFrame operators: contact maps, chats, messages, result sinks."""
